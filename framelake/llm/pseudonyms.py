"""Format-preserving pseudonyms for personal numbers and dates, by keyed Feistel permutations.

Values are found by pattern and validated (Luhn, calendar, octets, area codes, IBAN remainder); a valid value
is ranked among the values of its format, permuted by a Feistel network on that range (cycle-walking where the
range is not a product), and written back in its own format.  The permutation depends on key, kind and format
only, so equal values get equal pseudonyms in all documents, and the pseudonym of a card is a valid card again.

Defined results: a null text stays null, with no spans; a text without a valid value stays as it is, byte for byte; of
overlapping values the leftmost, then that of the kind listed first, counts; repeated rows get equal results; very long texts
are scanned whole; other columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import datetime as dt
import hmac
import re
from functools import lru_cache
from math import isqrt

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Session setting that holds the secret key; sessions without it (tests) get the key below, which hides nothing.
SETTING = "spark.framelake.pseudonym.key"
KEY = b"replace this key in production"
ROUNDS = 8


def session_key(spark: SparkSession) -> bytes:
    given = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    return given.encode() if given else KEY


def _stream(key: bytes, message: str, size: int) -> int:
    """Keyed pseudo-random integer with 128 bits more than size has."""
    out, k = b"", 0
    while 8 * len(out) < size.bit_length() + 128:
        out += hmac.digest(key, f"{message}:{k}".encode(), "sha256")
        k += 1
    return int.from_bytes(out, "big")


@lru_cache(1 << 18)
def permuted(n: int, size: int, key: bytes, tweak: str) -> int:
    """The place of n under a keyed permutation of range(size)."""
    if size < 2:
        return n
    left = isqrt(size - 1) + 1
    right = -(-size // left)
    while True:
        a, b = divmod(n, right)  # a < left, b < right
        for r in range(ROUNDS):
            f = _stream(key, f"{tweak}:{size}:{r}:{b if r % 2 == 0 else a}", left if r % 2 == 0 else right)
            if r % 2 == 0:
                a = (a + f) % left
            else:
                b = (b + f) % right
        n = a * right + b
        if n < size:
            return n


def _digits(text: str) -> str:
    return re.sub(r"\D", "", text)


def _refill(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10


def _card(text: str, key: bytes) -> str | None:
    d = _digits(text)
    if not 13 <= len(d) <= 19 or luhn(d) or len(set(d)) == 1:
        return None
    n = permuted(int(d[1:-1]), 10 ** (len(d) - 2), key, f"card{d[0]}{len(d)}")  # the first digit, the network's, stays
    body = d[0] + str(n).zfill(len(d) - 2)
    return _refill(text, body + str((10 - luhn(body + "0")) % 10))


def _iban(text: str, key: bytes) -> str | None:
    s = text.replace(" ", "")
    value = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(s) <= 34 or value(s[4:] + s[:4]) % 97 != 1:
        return None
    n = sum(c.isdigit() for c in s[4:])
    body = _refill(s[4:], str(permuted(int(_digits(s[4:]) or "0"), 10**n, key, f"iban{s[:2]}{len(s)}")).zfill(n) if n else "")
    s = s[:2] + f"{98 - value(body + s[:2] + '00') % 97:02d}" + body
    it = iter(s)
    return "".join(c if c == " " else next(it) for c in text)


def _phone(text: str, key: bytes) -> str | None:
    d = _digits(text)
    if not 10 <= len(d) <= 15:
        return None
    own = d[-10:]
    n = permuted(int(own), 10**10, key, f"phone{d[:-10]}")
    return _refill(text, d[:-10] + str(n).zfill(10))


def _ssn(text: str, key: bytes) -> str | None:
    a, g, s = text.split("-")
    valid = [x for x in range(1, 900) if x != 666]
    if int(a) not in valid or g == "00" or s == "0000":
        return None
    n = (valid.index(int(a)) * 99 + int(g) - 1) * 9999 + int(s) - 1
    n, s2 = divmod(permuted(n, len(valid) * 99 * 9999, key, "ssn"), 9999)
    a2, g2 = divmod(n, 99)
    return f"{valid[a2]:03d}-{g2 + 1:02d}-{s2 + 1:04d}"


FIRST, LAST = dt.date(1900, 1, 1), dt.date(2099, 12, 31)


def _date(text: str, key: bytes) -> str | None:
    parts = re.split(r"([-/.])", text)
    y, m, d = (0, 2, 4) if len(parts[0]) == 4 else (4, 2, 0)
    for a, b in ((m, d), (d, m)):  # year-month-day and day-month-year first, else month-day-year
        try:
            day = dt.date(int(parts[y]), int(parts[a]), int(parts[b]))
        except ValueError:
            continue
        if not FIRST <= day <= LAST:
            return None
        new = FIRST + dt.timedelta(permuted((day - FIRST).days, (LAST - FIRST).days + 1, key, "date"))
        parts[y], parts[a], parts[b] = f"{new.year:04d}", str(new.month).zfill(len(parts[a])), str(new.day).zfill(len(parts[b]))
        return "".join(parts)
    return None


def _ip(text: str, key: bytes) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    n = permuted(int.from_bytes(bytes(octets), "big"), 1 << 32, key, "ip")
    return ".".join(str(b) for b in n.to_bytes(4, "big"))


def _email(text: str, key: bytes) -> str | None:
    """Letters and digits of the name before @ are permuted within their kind; its shape and the host stay."""
    name, _, host = text.partition("@")
    radix = [26 if c.isascii() and c.isalpha() else 10 if c.isdigit() else 1 for c in name]
    low = lambda c: ord(c.lower()) - 97
    n, size = 0, 1
    for c, r in zip(name, radix, strict=True):
        n, size = n * r + (low(c) if r == 26 else int(c) if r == 10 else 0), size * r
    shape = "".join("x" if r == 26 else "9" if r == 10 else c for c, r in zip(name, radix, strict=True))
    n, out = permuted(n, size, key, f"email{shape}@{host.lower()}"), []
    for c, r in zip(reversed(name), reversed(radix), strict=True):
        n, v = divmod(n, r)
        out.append(chr(97 + v).upper() if r == 26 and c.isupper() else chr(97 + v) if r == 26 else str(v) if r == 10 else c)
    return "".join(reversed(out)) + "@" + host


#: Kind, pattern, validator and pseudonym; the order settles ties.
KINDS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", _email),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", _iban),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])", _ip),
    ("date", r"(?<![0-9./-])(?:[0-9]{4}(?P<s>[-/.])[0-9]{1,2}(?P=s)[0-9]{1,2}|[0-9]{1,2}(?P<t>[-/.])[0-9]{1,2}(?P=t)[0-9]{4})(?![0-9]|[./-][0-9])", _date),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])", _ssn),
    ("phone", r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9A-Za-z+])\+[0-9]{10,15}(?![0-9])", _phone),
    ("card", r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])", _card),
)
ANY = re.compile("|".join(f"(?:{p})" for _, p, _ in KINDS))
MAKE = {k: f for k, _, f in KINDS}
GROUPED = ("card", "iban")
SINGLE = [(k, re.compile(p)) for k, p, _ in KINDS]


def pseudonymise_text(text: str, key: bytes = KEY) -> tuple[str, list[tuple[str, int, int]]]:
    """(text with pseudonyms, spans (kind, start, end) in the original)."""
    out, spans, at, look = [], [], 0, 0
    while m := ANY.search(text, look):
        # another kind may match at the same place if the first is not valid
        for kind, pattern in SINGLE:
            own = pattern.match(text, m.start())
            start, end, new = (own.start(), own.end(), MAKE[kind](own.group(), key)) if own else (0, 0, None)
            # the last groups of a card or IBAN may be other words
            while own and new is None and kind in GROUPED and (end := max(text.rfind(c, start, end) for c in " -")) > start:
                new = MAKE[kind](text[start:end], key) if pattern.fullmatch(text, start, end) else None
            if new is not None:
                out += [text[at:start], new]
                spans.append((kind, start, end))
                at = look = end
                break
        else:
            look = m.start() + 1
    return "".join(out) + text[at:], spans


def pseudonymise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """One row per row of docs: id, text with pseudonyms, n_spans, spans (kind:start:end, comma-joined); one pass, no shuffle."""

    def run(batches):
        for batch in batches:
            text = batch.column(1)
            n, spans = [0] * len(text), [""] * len(text)
            # every value has a digit or @
            some = pc.fill_null(pc.match_substring_regex(text, "[0-9@]"), False)
            new = []
            for i in pc.indices_nonzero(some).to_pylist():
                t, found = pseudonymise_text(text[i].as_py(), key)
                new.append(t)
                n[i], spans[i] = len(found), ",".join(f"{k}:{a}:{b}" for k, a, b in found)
            if new:
                text = pc.replace_with_mask(text, some, pa.array(new, text.type))
            yield pa.RecordBatch.from_arrays([batch.column(0), text, pa.array(n, pa.int64()), pa.array(spans, pa.string())], names=[id_col, text_col, "n_spans", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, `{text_col}` string, n_spans long, spans string")
