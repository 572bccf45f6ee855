"""The redaction floor: personal and secret values in any text or JSON column become tokens.

`redact` is a vectorised column function. Rows without a single anchor of any pattern never reach Python: `redact_columns`
tests all columns of a row with one cheap regular expression each in the JVM. A recogniser is a regular expression with a check of
each match; the set can be extended or replaced.
"""

from __future__ import annotations

import base64
import binascii
import ipaddress
import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The order in which fired patterns are reported, and the form of a token.
REPORT_ORDER = ("PAN", "EMAIL", "IBAN", "SSN", "PHONE", "CVV", "TOKEN", "IP")
TOKEN = re.compile("⟦REDACTED:[A-Z0-9_]+⟧")
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IR": 26, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "MZ": 25, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22,
    "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_CVV_NAME = r"(?:card[_-]?)?(?:cvv2?|cvc2?|csc|security[_-]?code)"
_CVV_KEY = re.compile(rf"{_CVV_NAME}", re.I | re.A)
_SPACE = r"[\s ﻿]"
#: A JSON escape that may stand for a character of a pattern: strings are decoded before they are scanned.
_ESCAPE = r"\\(?:u[0-9a-fA-F]{4}|/)"
#: The union of what every pattern needs, for the JVM (also valid for RE2).
ANCHOR = (r"[0-9][0-9 -]{11,}[0-9]|@|[A-Za-z]{2}[0-9]{2}|[0-9]{3}-[0-9]{2}-[0-9]{4}|\+[0-9]|(?i:cvv|cvc|csc|security)|_live_|_test_|eyJ|(?i:bearer)|[A-Za-z0-9+/_-]{20}|" + _ESCAPE)
#: Same for addresses, which are not looked for unless asked.
_ANCHOR = re.compile(ANCHOR)
IP_ANCHOR = r"[0-9]+\.[0-9]+\.|[0-9a-fA-F]*:[0-9a-fA-F]*:|" + _ESCAPE


@dataclass(frozen=True)
class Recognizer:
    """A pattern id, a regular expression, and what of a match is sensitive: its span, or None. `others`: more expressions of the same id; of spans
    that overlap the one that starts first counts, of those with one start the longest."""

    id: str
    pattern: re.Pattern
    check: Callable[[re.Match], tuple[int, int] | None] = lambda m: m.span()
    others: tuple[tuple[re.Pattern, Callable[[re.Match], tuple[int, int] | None]], ...] = ()


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def _longest(m: re.Match, separators: str, groups: int, fits: Callable[[str], bool]) -> tuple[int, int] | None:
    """The longest run of whole groups from the start of a match that fits."""
    ends = [x.end() for x in re.finditer(rf"[^{separators}]+", m.group())][:groups]
    return next(((m.start(), m.start() + e) for e in reversed(ends) if fits(m.group()[:e])), None)


def _pan(m: re.Match):
    def fits(s: str) -> bool:
        digits = re.sub("[ -]", "", s)
        return 13 <= len(digits) <= 19 and luhn(digits)
    return _longest(m, " -", 5, fits)


def is_iban(s: str) -> bool:
    s = s.replace(" ", "").upper()
    if len(s) != IBAN_LENGTHS.get(s[:2]):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _iban(m: re.Match):
    return _longest(m, " ", 34, is_iban)


#: Ranges of country calling codes; numbers of other codes are no phone numbers.
CALLING_CODE_RANGES = (
    (1, 1), (7, 7), (20, 20), (27, 27), (30, 34), (36, 36), (39, 41), (43, 49), (51, 58), (60, 66), (81, 82), (84, 84),
    (86, 86), (90, 95), (98, 98), (212, 213), (216, 216), (218, 218), (220, 245), (248, 258), (260, 269), (297, 299), (350, 359), (370, 378),
    (380, 383), (385, 387), (389, 389), (420, 421), (423, 423), (500, 509), (590, 599), (670, 670), (673, 680), (682, 682), (685, 689), (691, 692),
    (850, 850), (852, 853), (855, 856), (880, 880), (886, 886), (960, 968), (970, 977), (992, 996), (998, 998),
)
CALLING_CODES = frozenset(str(c) for low, high in CALLING_CODE_RANGES for c in range(low, high + 1))


def is_phone(s: str) -> bool:
    """A plausible international number: a known calling code and a length that it allows."""
    digits = re.sub(r"\D", "", s)
    if digits.startswith("1"):
        return len(digits) == 11 and digits[1] in "23456789" and digits[4] in "23456789" and digits[2:4] != "11"
    code = next((digits[:n] for n in (3, 2, 1) if digits[:n] in CALLING_CODES), None)
    return code is not None and 7 <= len(digits) - len(code) <= 12 and len(digits) <= 15 and digits[len(code)] != "0"


def _phone(m: re.Match):
    ends = [x.end() for x in re.finditer(r"\(?[0-9]+\)?", m.group())][:8]
    ok = lambda s: 5 <= len(re.sub(r"\D", "", s)) <= 15 and is_phone(s)
    return next(((m.start(), m.start() + e) for e in reversed(ends) if ok(m.group()[:e]) and not re.match(r"\w", m.string[m.start() + e :][:1], re.A)), None)


def _email(m: re.Match):
    start = m.start() + len(m.group()) - len(m.group().lstrip("._%+-"))
    local, _, domain = m.string[start : m.end()].partition("@")
    labels = domain.split(".")
    good = local and ".." not in local and not local.endswith(".") and all(x and not x.startswith("-") and not x.endswith("-") for x in labels)
    return (start, m.end()) if good else None


def _ssn(m: re.Match):
    area, group, serial = m.group().split("-")
    return m.span() if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000" else None


def _jwt(m: re.Match):
    header = m.group().partition(".")[0]
    try:
        return m.span() if isinstance(json.loads(base64.urlsafe_b64decode(header + "=" * (-len(header) % 4))), dict) else None
    except (ValueError, UnicodeDecodeError):
        return None


def _ip(m: re.Match):
    try:
        ipaddress.ip_address(m.group())
    except ValueError:
        return None
    return m.span()


_A = re.A
#: The shapes of secrets (prefixed keys, signed web tokens, bearer values), card codes, account numbers, addresses and social security numbers,
#: in the order of application: each sees what the ones before it have left.
RECOGNIZERS = (
    Recognizer("TOKEN", re.compile(r"\b[a-z]{2}_(?:live|test)_[A-Za-z0-9]{6,}", _A), others=(
        (re.compile(r"\beyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}", _A), _jwt),
        (re.compile(rf"\b(?i:bearer){_SPACE}+([A-Za-z0-9._~+/=-]{{8,}})"), lambda m: m.span(1)))),
    Recognizer("CVV", re.compile(rf"\b(?i:{_CVV_NAME})\"?{_SPACE}*[:=]{_SPACE}*\"?([0-9]{{3,4}})(?![0-9])"), lambda m: m.span(1)),
    Recognizer("IBAN", re.compile(r"(?<!\w)[A-Za-z]{2}[0-9]{2}(?:[A-Za-z0-9]| (?=[A-Za-z0-9])){11,60}(?!\w)", _A), _iban),
    Recognizer("PHONE", re.compile(r"(?<!\w)\+[0-9]+(?:[ .-]?\(?[0-9]+\)?)*", _A), _phone),
    Recognizer("PAN", re.compile(r"(?<!\w)[0-9]+(?:[ -][0-9]+)*(?!\w)", _A), _pan),
    Recognizer("EMAIL", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), _email),
    Recognizer("SSN", re.compile(r"(?<!\w)[0-9]{3}-[0-9]{2}-[0-9]{4}(?!\w)", _A), _ssn),
)
IP_RECOGNIZER = Recognizer("IP", re.compile(r"(?<![\w.:])(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*)(?![\w:])", _A), _ip)
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_DECODER = json.JSONDecoder(strict=False)
_LEAF = re.compile(r'"((?:[^"\\]|\\.)*)("?)(\s*:)?|-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?')


def _plain(text: str, recognizers: Iterable[Recognizer], fired: set[str]) -> str:
    """One stretch of text without tokens: every recogniser in turn, then base64 runs that hold something."""
    for r in recognizers:
        if "⟦" not in text:
            text = _apply(text, r, fired)
            continue
        tokens, pieces = TOKEN.findall(text), TOKEN.split(text)  # what an earlier recogniser has replaced is left alone
        text = "".join(_apply(piece, r, fired) + token for piece, token in zip(pieces, [*tokens, ""], strict=True))
    return text


def _apply(text: str, r: Recognizer, fired: set[str]) -> str:
    out, at = [], 0
    if r.others:
        spans = [span for pattern, check in ((r.pattern, r.check), *r.others) for m in pattern.finditer(text) if (span := check(m))]
        for start, end in sorted(spans, key=lambda x: (x[0], -x[1])):
            if start >= at:
                out += [text[at:start], f"⟦REDACTED:{r.id}⟧"]
                fired.add(r.id)
                at = end
        return "".join([*out, text[at:]])
    m = r.pattern.search(text)
    while m:
        span = r.check(m)
        if span and span[0] >= at:
            out += [text[at : span[0]], f"⟦REDACTED:{r.id}⟧"]
            fired.add(r.id)
            at = span[1]
            m = r.pattern.search(text, max(at, m.start() + 1))
        elif r.id == "PAN":  # a run that fails from one group may hold a number from the next
            following = re.compile("[ -]").search(text, m.start(), m.end())
            m = r.pattern.search(text, following.end() if following else m.end())
        else:
            m = r.pattern.search(text, m.end() if m.end() > m.start() else m.start() + 1)
    return "".join([*out, text[at:]])


def _base64_text(run: str) -> str | None:
    body = run.rstrip("=")
    if len(body) % 4 == 1 or (set(body) & set("+/") and set(body) & set("-_")):
        return None
    try:
        text = base64.b64decode(body + "=" * (-len(body) % 4), altchars=b"-_" if set(body) & set("-_") else None, validate=True).decode()
    except (binascii.Error, UnicodeDecodeError):
        return None
    return text if not re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", text) else None


def redact_scalar(text: str, fired: set[str], recognizers=RECOGNIZERS, key: str | None = None) -> str:
    if key is not None and _CVV_KEY.fullmatch(key) and re.fullmatch("[0-9]{3,4}", text):
        fired.add("CVV")
        return "⟦REDACTED:CVV⟧"
    if recognizers is RECOGNIZERS and not _ANCHOR.search(text):  # a value without an anchor holds nothing
        return text

    def run(m: re.Match) -> str:
        inner: set[str] = set()
        decoded = _base64_text(m.group())
        if decoded is not None:
            _plain(decoded, recognizers, inner)
        first = next((x for x in REPORT_ORDER if x in inner), None)
        if first is None:
            return m.group()
        fired.add(first)
        return f"⟦REDACTED:{first}⟧"

    return _plain(_BASE64.sub(run, text), recognizers, fired)


def _json(text: str, fired: set[str], recognizers) -> str:
    """Strings and integers of JSON text, complete or cut off, are replaced in place; every other byte stays."""
    key: list[str | None] = [None]

    def leaf(m: re.Match) -> str:
        if m.group(1) is None:
            digits, own = m.group(), key[0]
            if own is not None and _CVV_KEY.fullmatch(own) and re.fullmatch("[0-9]{3,4}", digits):
                fired.add("CVV")
                return '"⟦REDACTED:CVV⟧"'
            if re.fullmatch("[0-9]{13,19}", digits) and luhn(digits):
                fired.add("PAN")
                return '"⟦REDACTED:PAN⟧"'
            return digits
        raw, closing, colon = m.group(1), m.group(2), m.group(3) or ""
        try:
            value = _DECODER.decode(f'"{raw}"') if "\\" in raw else raw
        except ValueError:
            value = raw
        inner: set[str] = set()
        clean = redact_scalar(value, inner, recognizers, None if colon else key[0])
        key[0] = value if colon else None
        if not inner:
            return m.group()
        fired.update(inner)
        return f'"{json.dumps(clean, ensure_ascii=False)[1:-1]}{closing}{colon}'

    return _LEAF.sub(leaf, text)


def redact_text(text: str, recognizers: Iterable[Recognizer] | None = None) -> tuple[str, list[str]]:
    """The text with tokens and the fired pattern ids in report order. Tokens that are there already are left alone, so that
    the result of a second pass is the same."""
    recognizers = RECOGNIZERS if recognizers is None else recognizers
    fired: set[str] = set()
    if text.lstrip()[:1] in ("{", "["):
        out = _json(text, fired, recognizers)
    elif re.fullmatch(r"[^\s=&]+=[^\s&]*(?:&[^\s=&]+=[^\s&]*)*", text):  # a form body: pair by pair
        pairs = [p.partition("=") for p in text.split("&")]
        out = "&".join(redact_scalar(k, fired, recognizers) + s + redact_scalar(v, fired, recognizers, k) for k, s, v in pairs)
    else:
        out = redact_scalar(text, fired, recognizers)
    return out, [x for x in REPORT_ORDER if x in fired]


def _chosen(recognizers: Iterable[Recognizer], ip: bool = False) -> tuple[Recognizer, ...] | None:
    """What a task is sent: null for the recognisers that it has itself, so that it knows what their anchors are."""
    own = (*recognizers, IP_RECOGNIZER) if ip else tuple(recognizers)
    return None if own == RECOGNIZERS else own


RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("patterns", T.ArrayType(T.StringType()))])


def make_redact(recognizers: Iterable[Recognizer] = RECOGNIZERS, ip: bool = False):
    """A pandas UDF text -> struct<text, patterns>."""
    chosen = _chosen(recognizers, ip)

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [(None, []) if t is None else redact_text(t, chosen) for t in texts]
        return pd.DataFrame(rows, columns=["text", "patterns"])

    return run


def needs_redaction(column: Column, ip: bool = False) -> Column:
    return F.coalesce(column.rlike(f"{ANCHOR}|{IP_ANCHOR}" if ip else ANCHOR), F.lit(False))


def redact(df: DataFrame, column: str, *, recognizers: Iterable[Recognizer] = RECOGNIZERS, ip: bool = False, patterns: str = "patterns") -> DataFrame:
    """df with the column redacted and the fired pattern ids in a column of their own. Rows without an anchor of any
    pattern go to Python as nulls. The table is read once."""
    own = F.col(column) if tuple(recognizers) != RECOGNIZERS else F.when(needs_redaction(F.col(column), ip), F.col(column))
    done = df.withColumn("_redacted", make_redact(recognizers, ip)(own))
    return done.withColumns({column: F.coalesce("_redacted.text", column), patterns: F.col("_redacted.patterns")}).drop("_redacted")


def contains_token(column: Column) -> Column:
    return column.rlike("⟦REDACTED:[A-Z0-9_]+⟧")


def whole_token_id(column: Column) -> Column:
    return F.nullif(F.regexp_extract(column, "^⟦REDACTED:([A-Z0-9_]+)⟧$", 1), F.lit(""))


def census(df: DataFrame, *by: str, patterns: str = "patterns") -> DataFrame:
    """How many rows fired which pattern."""
    return df.select(*by, F.explode(patterns).alias("pattern")).groupBy(*by, "pattern").agg(F.count("*").alias("n_rows"))


def pan_digits(column: Column) -> Column:
    """Bare digit runs that are card numbers, without Python: 13 to 19 digits between non-word characters, checked by Luhn."""
    runs = F.regexp_extract_all(F.concat(F.lit(" "), F.regexp_replace(F.coalesce(column, F.lit("")), "([^0-9A-Za-z_])", "$1 "), F.lit(" ")), F.lit(r"[^0-9A-Za-z_]([0-9]{13,19})[^0-9A-Za-z_]"), 1)

    def check(run: Column) -> Column:
        digits = F.transform(F.split(F.reverse(run), ""), lambda d, i: d.cast("int") * (1 + i % 2))
        return F.aggregate(digits, F.lit(0), lambda a, d: a + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0

    return F.filter(runs, check)


#: Fixed value: characters of redacted text that a task holds as Python objects, beside the batch that it has been given.
PORTION = 1 << 20


def redact_record(df: DataFrame, *columns: str, existing: str | None = None, patterns: str = "patterns", recognizers: Iterable[Recognizer] = RECOGNIZERS, ip: bool = False, fields: dict[str, str] | None = None) -> DataFrame:
    """RED17: all text columns of a record in one pass over Python; the fired ids of all columns, with those in `existing`, as a
    sorted set. Columns without an anchor go to Python as nulls, and unchanged ones come back as nulls. fields: for some of the columns, the name of a column with what `redacted_fields` says of them.

    The pass counts as nondeterministic, so that a filter on what it has found does not repeat it."""
    chosen, fields = _chosen(recognizers, ip), fields or {}
    told = [c in fields for c in columns]
    result = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(columns))] + [T.StructField("p", T.ArrayType(T.StringType()))] + [T.StructField(f"f{i}", FIELD) for i, x in enumerate(told) if x])
    kinds = [*[pa.string()] * len(columns), pa.list_(pa.string()), *[_FIELD_ARROW] * sum(told)]

    def run(*texts: pa.Array) -> pa.Array:
        chunk = lambda rows: pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], result.names)
        chunks, rows, held = [], [], 0
        for row in zip(*texts, strict=True):
            new, fired, found = [], set(), []
            for cell, with_fields in zip(row, told, strict=True):
                old = cell.as_py()
                text, own = (None, []) if old is None else redact_text(old, chosen)
                fired.update(own)
                new.append(None if text == old else text)
                held += len(new[-1] or "")
                if with_fields:
                    found.append(_fields_of(old, new[-1]) if new[-1] is not None else [])
            rows.append([*new, sorted(fired), *found])
            if held > PORTION:
                chunks.append(chunk(rows))
                rows, held = [], 0
        return pa.concat_arrays([*chunks, chunk(rows)])

    run.__annotations__ = {"return": pa.Array} | {"texts": pa.Array}
    once = F.arrow_udf(run, result).asNondeterministic()
    none = F.array().cast("array<string>")
    before = F.coalesce(F.col(existing), none) if existing else none
    done = df.withColumn("_r", once(*[F.when(needs_redaction(F.col(c), ip), F.col(c)) for c in columns])).withColumn("_all", F.array_sort(F.array_union(before, F.col("_r.p"))))
    return done.withColumns({c: F.coalesce(f"_r.c{i}", c) for i, c in enumerate(columns)} | {fields[c]: F.col(f"_r.f{i}") for i, c in enumerate(columns) if told[i]}).withColumn(patterns, F.col("_all")).drop("_r", "_all")


def merge_fields(existing: Column, found: Column) -> Column:
    """RED17: records (part, path, ...) of both arrays, one for each part and path; an existing one wins."""
    key = lambda x: F.struct(x["part"].alias("part"), x["path"].alias("path"))
    have = F.transform(existing, key)
    return F.concat(existing, F.filter(found, lambda x: ~F.array_contains(have, key(x))))


def redact_call_records(df: DataFrame, parts: dict[str, str], *, patterns: str = "patterns", fields: str = "fields", recognizers: Iterable[Recognizer] = RECOGNIZERS) -> DataFrame:
    """RED17: the record pass. parts: the name of each text column's part; `patterns` (array<string>) and `fields` (array<struct<part, path, pattern,
    ...>>), which the record has, are added to and never lose an entry."""
    told = {c: f"_fields_{c}" for c in parts}
    done = redact_record(df, *parts, existing=patterns, patterns=patterns, recognizers=recognizers, fields=told)
    kind = df.schema[fields].dataType.elementType

    def of_part(column: str, part: str) -> Column:
        record = lambda x: F.struct(*[(F.lit(part) if name == "part" else x[name] if name in FIELD.elementType.names else F.lit(None)).cast(kind[name].dataType).alias(name) for name in kind.names])
        return F.transform(told[column], lambda x: record(x))

    found = F.flatten(F.array(*[of_part(c, part) for c, part in parts.items()]))
    return done.withColumn(fields, merge_fields(F.coalesce(F.col(fields), F.array().cast(done.schema[fields].dataType)), found)).drop(*told.values())


def redact_snapshots(df: DataFrame, document: str = "snapshot_json", command: str = "server_command", recognizers: Iterable[Recognizer] = RECOGNIZERS) -> DataFrame:
    """RED18: the listing as JSON text, and each element of the command (a JSON array of strings) on its own; a command that is no such array is text."""
    chosen = _chosen(recognizers)

    @F.pandas_udf("document string, elements array<string>, text string")
    def run(documents: pd.Series, commands: pd.Series, texts: pd.Series) -> pd.DataFrame:
        known: dict[str, str] = {}  # commands repeat

        def one(text):
            if text is None:
                return None
            if text not in known:
                known[text] = redact_text(text, chosen)[0]
            return known[text]

        rows = [(None if d is None else redact_text(d, chosen)[0], None if c is None else [one(x) for x in c], one(t)) for d, c, t in zip(documents, commands, texts, strict=True)]
        return pd.DataFrame(rows, columns=["document", "elements", "text"])

    wanted = lambda c: F.when(needs_redaction(c), c)
    out = df.withColumn("_c", F.from_json(command, "array<string>")).withColumn("_t", F.when(F.col("_c").isNull(), F.col(command)))
    out = out.withColumn("_r", run(wanted(F.col(document)), "_c", wanted(F.col("_t"))))
    return out.withColumns({document: F.coalesce("_r.document", document), command: F.coalesce(F.to_json("_r.elements"), "_r.text", "_t")}).drop("_c", "_t", "_r")


def redact_nested(df: DataFrame, column: str, recognizers: Iterable[Recognizer] = RECOGNIZERS) -> DataFrame:
    """RED15: keys and values of a map, struct or array column, by way of its JSON text. A field of another type than string whose value became a token is null."""
    kind = df.schema[column].dataType
    out = redact_record(df.withColumn("_j", F.to_json(column)), "_j", patterns="_p", recognizers=recognizers)
    return out.withColumn(column, F.from_json("_j", kind)).drop("_j", "_p")


def redact_findings(findings: DataFrame, columns: tuple[str, ...] = ("expected", "actual", "detail"), recognizers: Iterable[Recognizer] = RECOGNIZERS) -> DataFrame:
    """PRJ4: what a finding says is redacted again on its way out."""
    return redact_record(findings, *columns, patterns="_p", recognizers=recognizers).drop("_p")


def redact_elements(df: DataFrame, column: str, recognizers: Iterable[Recognizer] = RECOGNIZERS) -> DataFrame:
    """RED18: each element of an array of strings on its own, in place."""
    chosen = _chosen(recognizers)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: None if a is None else [None if t is None else redact_text(t, chosen)[0] for t in a])

    return df.withColumn(column, run(column))


def escape_pointer(name: str) -> str:
    return name.replace("~", "~0").replace("/", "~1")


def value_properties(text: str) -> dict:
    """RED14: what is kept of a value that a token has replaced: its length and the kinds of characters in it."""
    return {
        "type": "string", "length": len(text), "containsLowerCase": any(c.islower() for c in text), "containsUpperCase": any(c.isupper() for c in text), "containsDigits": any(c in "0123456789" for c in text),
        "containsASCIIControlChars": any(ord(c) < 32 or ord(c) == 127 for c in text), "containsASCIIPrintableChars": any(32 <= ord(c) < 127 for c in text), "containsASCIIExtendedChars": any(128 <= ord(c) < 256 for c in text),
    }


FIELD = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("pattern", T.StringType()), T.StructField("type", T.StringType()), T.StructField("length", T.IntegerType())]
                                 + [T.StructField(x, T.BooleanType()) for x in list(value_properties(""))[2:]]))


_FIELD_ARROW = pa.list_(pa.struct([(f.name, {"string": pa.string(), "integer": pa.int32(), "boolean": pa.bool_()}[f.dataType.typeName()]) for f in FIELD.elementType]))


def _fields_of(before: str | None, after: str | None) -> list[dict]:
    def walk(old, new, path, out):
        if isinstance(old, dict) and isinstance(new, dict):
            for key, value in old.items():
                if key in new:
                    walk(value, new[key], f"{path}/{escape_pointer(key)}", out)
        elif isinstance(old, list) and isinstance(new, list):
            for k, (a, b) in enumerate(zip(old, new, strict=False)):
                walk(a, b, f"{path}/{k}", out)
        elif isinstance(new, str) and new != old and (m := re.fullmatch("⟦REDACTED:([A-Z0-9_]+)⟧", new)):
            own = value_properties(old if isinstance(old, str) else str(old))
            out.append({"path": path, "pattern": m.group(1)} | own | ({"type": "integer"} if isinstance(old, int) else {}))
        return out

    try:
        return walk(json.loads(before), json.loads(after), "", [])
    except (TypeError, ValueError):
        return []


@F.pandas_udf(FIELD)
def redacted_fields(before: pd.Series, after: pd.Series) -> pd.Series:
    """Records of the JSON scalars that redaction has replaced as a whole: RFC 6901 path, pattern id, properties of the original."""
    return pd.Series([_fields_of(a, b) for a, b in zip(before, after, strict=True)], dtype=object)


def enhance(df: DataFrame, column: str, sensitive: list[tuple[str, str]]) -> DataFrame:
    """RED16: string and number leaves at the given (path, id) become tokens; `[]` after a name stands for every element. A leaf that holds a token
    stays. Text that is no JSON stays."""
    wanted = [(p.replace("[]", ".[]").split("."), i) for p, i in sensitive]

    def put(node, steps, i):
        if not steps:
            fits = isinstance(node, (str, int, float)) and not isinstance(node, bool) and not (isinstance(node, str) and TOKEN.search(node))
            return f"⟦REDACTED:{i}⟧" if fits else node
        if steps[0] == "[]":
            return [put(x, steps[1:], i) for x in node] if isinstance(node, list) else node
        if isinstance(node, dict) and steps[0] in node:
            return node | {steps[0]: put(node[steps[0]], steps[1:], i)}
        return node

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                value = json.loads(text)
            except (TypeError, ValueError):
                return text
            out = value
            for steps, i in wanted:
                out = put(out, steps, i)
            return text if out == value else json.dumps(out, ensure_ascii=False, separators=(",", ":"))
        return pd.Series([one(t) for t in texts], dtype=object)

    return df.withColumn(column, run(column))
