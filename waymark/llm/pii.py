"""Personal data replaced by format-preserving pseudonyms.

Values are found by pattern and validated (check digits, calendar, ranges).
Each is then permuted within its own format by a keyed Feistel network: a
card number becomes another valid card number with the same separators, a
date another date written the same way. The permutation depends on the key,
the kind and the format only, so equal values stay equal across documents,
different ones stay different, and whoever holds the key can turn them back.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.shared import only

ROUNDS = 10
# The session setting that holds the key, and the key for trials without one: whoever reads this can turn its pseudonyms back.
KEY_SETTING = "spark.waymark.pii.key"
TRIAL_KEY = b"replace this key by your own"

_LOWER, _UPPER, _DIGIT, _HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
_FIRST_DAY, _LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


class Feistel:
    """Keyed permutations of numbers written in mixed radices."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = blake2b(key, digest_size=32).digest(), rounds

    def _noise(self, tweak: bytes, step: int, half: int, modulus: int) -> int:
        body = half.to_bytes((half.bit_length() + 7) // 8 + 1, "little")
        mac = blake2b(body, key=self.key, person=step.to_bytes(16, "little"), salt=blake2b(tweak, digest_size=16).digest())
        return int.from_bytes(mac.digest(), "little") % modulus

    def permute(self, digits: list[int], radices: list[int], tweak: bytes, back: bool = False) -> list[int]:
        """The image of a number under the permutation of its format, or with
        `back` what it is the image of."""
        if len(digits) == 1:  # too short for two halves: split the one digit's range instead
            shift = self._noise(tweak, 0, 0, radices[0])
            return [(digits[0] + (-shift if back else shift)) % radices[0]]
        cut = len(digits) // 2
        left, a = _number(digits[:cut], radices[:cut])
        right, b = _number(digits[cut:], radices[cut:])
        for step in reversed(range(self.rounds)) if back else range(self.rounds):
            if step % 2:
                noise = self._noise(tweak, step, left, b)
                right = (right + (-noise if back else noise)) % b
            else:
                noise = self._noise(tweak, step, right, a)
                left = (left + (-noise if back else noise)) % a
        return _digits(left, radices[:cut]) + _digits(right, radices[cut:])


def _number(digits: list[int], radices: list[int]) -> tuple[int, int]:
    value, size = 0, 1
    for digit, radix in zip(digits, radices, strict=True):
        value, size = value * radix + digit, size * radix
    return value, size


def _digits(value: int, radices: list[int]) -> list[int]:
    out = []
    for radix in reversed(radices):
        value, digit = divmod(value, radix)
        out.append(digit)
    return out[::-1]


def luhn_digit(digits: list[int]) -> int:
    """The check digit for a number without it."""
    total = 0
    for at, digit in enumerate(reversed(digits)):
        doubled = digit * 2 if at % 2 == 0 else digit
        total += doubled - 9 if doubled > 9 else doubled
    return -total % 10


def iban_check(country: str, rest: str) -> str:
    moved = "".join(str(int(char, 36)) for char in rest + country + "00")
    return f"{98 - int(moved) % 97:02d}"


def _ints(text: str) -> list[int]:
    return [int(char) for char in text if char in _DIGIT]


def _refill(pattern: str, digits: list[int]) -> str:
    """The text with its digits replaced in order."""
    given = iter(digits)
    return "".join(str(next(given)) if char in _DIGIT else char for char in pattern)


def _by_class(feistel: Feistel, text: str, kind: str, back: bool, hexadecimal: bool = False) -> str:
    """Letters and digits permuted within their class; the rest stays. The
    classes of all places are the format."""
    classes = [
        next((c for c in ((_HEX,) if hexadecimal else (_LOWER, _UPPER, _DIGIT)) if char in c), None) for char in text
    ]
    places = [at for at, chars in enumerate(classes) if chars]
    if not places:
        return text
    radices = [len(classes[at]) for at in places]
    digits = [classes[at].index(text[at]) for at in places]
    tweak = (kind + ":" + ",".join(map(str, radices))).encode()
    out = list(text)
    for at, digit in zip(places, feistel.permute(digits, radices, tweak, back), strict=True):
        out[at] = classes[at][digit]
    return "".join(out)


def _walk(step: Callable[[list[int]], list[int]], digits: list[int], valid: Callable[[list[int]], bool]) -> list[int]:
    """Cycle walking: permute until the value is valid again; a permutation of
    the valid values, as the walk starts from one and can't leave its cycle."""
    while True:
        digits = step(digits)
        if valid(digits):
            return digits


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: its pattern, whether a match is valid, and its pseudonym."""

    name: str
    pattern: re.Pattern
    valid: Callable[[re.Match], bool]
    replace: Callable[[Feistel, re.Match, bool], str]


def _email(feistel: Feistel, match: re.Match, back: bool) -> str:
    lower = match[1].lower()
    new = _by_class(feistel, lower, "email", back)
    cased = "".join(n.upper() if old.isupper() else n for old, n in zip(match[1], new, strict=True))
    return cased + match[0][len(match[1]) :]


def _secret(feistel: Feistel, match: re.Match, back: bool) -> str:
    value = match["value"]
    hexadecimal = all(char in _HEX for char in value)
    new = _by_class(feistel, value, "hex" if hexadecimal else "secret", back, hexadecimal)
    begin = match.start("value") - match.start()
    return match[0][:begin] + new + match[0][begin + len(value) :]


def _access_key(feistel: Feistel, match: re.Match, back: bool) -> str:
    chars = _UPPER + _DIGIT
    body = [chars.index(char) for char in match[0][4:]]
    new = feistel.permute(body, [36] * len(body), b"access key", back)
    return match[0][:4] + "".join(chars[digit] for digit in new)


def _iban(feistel: Feistel, match: re.Match, back: bool) -> str:
    plain = match[0].replace(" ", "")
    rest = _by_class(feistel, plain[4:], "iban", back)
    new = iter(plain[:2] + iban_check(plain[:2], rest) + rest)
    return "".join(char if char == " " else next(new) for char in match[0])


def _card(feistel: Feistel, match: re.Match, back: bool) -> str:
    digits = _ints(match[0])
    body = digits[:-1]
    new = _walk(
        lambda d: feistel.permute(d, [10] * len(d), b"card", back),
        body,
        lambda d: d[0] != 0,
    )
    return _refill(match[0], [*new, luhn_digit(new)])


def _phone(feistel: Feistel, match: re.Match, back: bool) -> str:
    digits = _ints(match[0])
    code, body = digits[:-10], digits[-10:]
    return _refill(match[0], [*code, *feistel.permute(body, [10] * 10, b"phone", back)])


def _ssn(feistel: Feistel, match: re.Match, back: bool) -> str:
    new = _walk(lambda d: feistel.permute(d, [10] * 9, b"ssn", back), _ints(match[0]), _ssn_digits)
    return _refill(match[0], new)


def _ssn_digits(d: list[int]) -> bool:
    area, group, serial = (int("".join(map(str, part))) for part in (d[:3], d[3:5], d[5:]))
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _ip(feistel: Feistel, match: re.Match, back: bool) -> str:
    octets = [int(part) for part in match[0].split(".")]
    return ".".join(map(str, feistel.permute(octets, [256] * 4, b"ip", back)))


def _day_first(match: re.Match) -> bool:
    """Whether a date with slashes can only be read day first; others are read month first."""
    return match["m3"] is not None and int(match["m3"]) > 12


def _day(match: re.Match) -> int | None:
    parts = match.groupdict()
    year, month, day = (int(parts[part] or parts[f"{part}2"] or parts[f"{part}3"]) for part in "ymd")
    if _day_first(match):
        month, day = day, month
    try:
        day = date(year, month, day).toordinal()
    except ValueError:
        return None
    return day if _FIRST_DAY <= day <= _LAST_DAY else None


def _date(feistel: Feistel, match: re.Match, back: bool) -> str:
    span = _LAST_DAY - _FIRST_DAY + 1
    radices = [-(-span // 256), 256]
    start = _digits(_day(match) - _FIRST_DAY, radices)
    day_first = _day_first(match)

    def valid(digits: list[int]) -> bool:
        at, _ = _number(digits, radices)
        # Day first stays day first, or the way back would read it the other way round.
        return at < span and (not day_first or date.fromordinal(_FIRST_DAY + at).day > 12)

    new = _walk(lambda d: feistel.permute(d, radices, b"date", back), start, valid)
    day = date.fromordinal(_FIRST_DAY + _number(new, radices)[0])
    if match["y"]:
        return f"{day.year:04d}{match['s']}{day.month:02d}{match['s']}{day.day:02d}"
    if match["y2"]:
        return f"{day.day:02d}.{day.month:02d}.{day.year:04d}"
    if day_first:
        return f"{day.day:02d}/{day.month:02d}/{day.year:04d}"
    return f"{day.month:02d}/{day.day:02d}/{day.year:04d}"


# In order of precedence where matches overlap.
KINDS = (
    Kind(
        "email",
        re.compile(r"(?<![\w.+%-])([A-Za-z0-9][A-Za-z0-9._%+-]{0,63})@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.)+[A-Za-z]{2,24}(?![\w@])"),
        lambda match: True,
        _email,
    ),
    Kind(
        "secret",
        re.compile(
            r"(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\b[\"']?\s*[:=]\s*"
            r"[\"']?(?P<value>[A-Za-z0-9_\-+/.]*[0-9][A-Za-z0-9_\-+/]{4,}|[A-Za-z0-9_\-+/.]{5,}[0-9])"
        ),
        lambda match: len(match["value"]) >= 6,
        _secret,
    ),
    Kind("access_key", re.compile(r"(?<![A-Za-z0-9])A(?:KIA|SIA)[A-Z0-9]{16}(?![A-Za-z0-9])"), lambda match: True, _access_key),
    Kind(
        "iban",
        re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
        lambda match: match[0].replace(" ", "")[2:4] == iban_check(match[0][:2], match[0].replace(" ", "")[4:]),
        _iban,
    ),
    Kind(
        "card",
        re.compile(r"(?<![\w.+-])[1-9][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![\w-])|(?<![\w.+-])3[0-9]{3}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![\w-])"),
        lambda match: 13 <= len(_ints(match[0])) <= 19 and luhn_digit(_ints(match[0])[:-1]) == _ints(match[0])[-1],
        _card,
    ),
    Kind(
        "phone",
        re.compile(r"(?<![\w+.-])(?:\+[1-9][0-9]{0,2}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])"),
        lambda match: True,
        _phone,
    ),
    Kind("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"), lambda match: _ssn_digits(_ints(match[0])), _ssn),
    Kind(
        "ip",
        re.compile(r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9])"),
        lambda match: all(int(p) < 256 and str(int(p)) == p for p in match[0].split(".")),
        _ip,
    ),
    Kind(
        "date",
        re.compile(
            r"(?<![\w./-])(?:(?P<y>[12][0-9]{3})(?P<s>[-/])(?P<m>[0-9]{2})(?P=s)(?P<d>[0-9]{2})"
            r"|(?P<d2>[0-9]{2})\.(?P<m2>[0-9]{2})\.(?P<y2>[12][0-9]{3})"
            r"|(?P<m3>[0-9]{2})/(?P<d3>[0-9]{2})/(?P<y3>[12][0-9]{3}))(?![\w/-])"
        ),
        lambda match: _day(match) is not None,
        _date,
    ),
)

# Every kind holds a digit or an @ sign; most texts end here.
_ANY = re.compile(r"[0-9@]")


def spans(text: str) -> list[tuple[int, int, Kind, re.Match]]:
    """The valid values of a text, left to right; of overlapping ones the
    kind named first in KINDS."""
    if not _ANY.search(text):
        return []
    found: list[tuple[int, int, Kind, re.Match]] = []
    for kind in KINDS:
        merged, at = [], 0
        for match in kind.pattern.finditer(text):
            if not kind.valid(match):
                continue
            # Both lists go left to right and overlap nowhere: one sweep per kind.
            while at < len(found) and found[at][1] <= match.start():
                merged.append(found[at])
                at += 1
            if at == len(found) or match.end() <= found[at][0]:
                merged.append((match.start(), match.end(), kind, match))
        found = merged + found[at:]
    return found


def pseudonymise_text(text: str, feistel: Feistel, back: bool = False) -> tuple[str, list[str]]:
    """The text with pseudonyms for its values, and the kinds replaced. With
    `back` the original values return: a pseudonym is a valid value itself."""
    parts, at, kinds = [], 0, []
    for begin, end, kind, match in spans(text):
        parts += [text[at:begin], kind.replace(feistel, match, back)]
        kinds.append(kind.name)
        at = end
    return "".join([*parts, text[at:]]), kinds


def session_key(spark: SparkSession) -> bytes:
    """The key the session names; without one the trial key, with a warning."""
    if key := spark.conf.get(KEY_SETTING, None):
        return key.encode()
    warnings.warn(f"{KEY_SETTING} is not set: pseudonyms use the published trial key", stacklevel=2)
    return TRIAL_KEY


@lru_cache(maxsize=4)
def _feistel(key: bytes) -> Feistel:
    return Feistel(key)


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", found: str | None = None) -> DataFrame:
    """All columns of `docs` with the text pseudonymised; `found` names a new
    column for the kinds replaced, in order of place.

    Row by row: nothing is shuffled, repeated rows stay, a NULL text stays
    NULL, an empty table gives no rows. Texts of any length are read whole.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feistel = _feistel(key)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts, kinds = [], []
            for body in batch.column(at):
                new, names = (None, []) if (old := body.as_py()) is None else pseudonymise_text(old, feistel)
                texts.append(new)
                kinds.append(names)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            if found:
                columns.append(pa.array(kinds, pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *([found] if found else [])])

    schema = docs.schema
    if found:
        schema = docs.select("*", F.lit(None).cast("array<string>").alias(found)).schema
    return docs.mapInArrow(rewrite, schema)


def report(docs: DataFrame, key: bytes, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text (pseudonymised), n_found, kinds (distinct, sorted, comma-joined)."""
    done = pseudonymise(only(docs, doc_id=id, text=text), key, found="kinds")
    return done.select(
        "doc_id",
        "text",
        F.size("kinds").cast("long").alias("n_found"),
        F.array_join(F.array_sort(F.array_distinct("kinds")), ",").alias("kinds"),
    )
