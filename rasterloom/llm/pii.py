"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

Numbers and dates that pass validation are permuted within their format by a keyed Feistel network:
equal values get equal pseudonyms in all documents, different ones different, and a pseudonym passes
the same validation. Kinds, and what is permuted:

* card: 13 to 19 digits, in groups or not, with a right Luhn digit; all but that digit, which is set anew
* iban: country, check digits and account with remainder 1 (mod 97); the account, then new check digits
* ssn: area, group and serial with hyphens, each in its valid range
* phone: ``+`` and country code, or the North American form without one; the digits after the country code
* ipv4: four numbers up to 255; the 32-bit address
* date: year-month-day, day.month.year or month/day/year, an existing day of 1900 to 2099
* email: the letters and digits before the @, whatever their number, each within its own kind; a host has 127 labels
  at most, as in the DNS
* token: 16 or more letters and digits after a name such as token, key or secret; each within its kind,
  hex digits within hex digits

Characters are permuted by halves: each letter or digit of one half moves within its alphabet by a hash
of the other half, in turn, eight times. Numbers with a range are permuted as two residues the same way.
What is permuted is the bare value: a card's digits without separators, an account without spaces, a
subscriber number without country code or punctuation, a name in lower case. Separators and case are put
back afterwards, so that one value has one pseudonym in all its spellings.

A match that fails validation is tried again by the groups it has between spaces and hyphens: from each
group on, the longest run of groups that is valid is replaced, and the rest is looked at further.

Edge cases: a null text stays null, an empty one empty. Numbers that fail validation stay as they are.
Where kinds overlap the first to begin counts. Texts of any length are rewritten whole. An empty table has an
empty result. Repeated rows, null ids and extra columns pass through, but for one named pii, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

_SECRET = r"(?i:token|api[_-]?key|key|secret|password|passwd|pwd)[\"']?\s{0,4}[=:]\s{0,4}[\"']?"
#: Kinds in the order in which they are tried at a place.
PATTERNS = {
    "token": _SECRET + r"[0-9A-Za-z_\-]{16,}",
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]+\.){1,126}[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9.\-/])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9\-/])(?!\.[0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "ipv4": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])(?!\.[0-9])",
    "phone": r"\+[0-9]{1,3}[ .\-]?\(?[0-9]{1,4}\)?(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Days from 1900-01-01 to 2099-12-31: 73,049, which is 17 times 4,297.
_DAYS = (17, 4297)


def _let(value: Column, body) -> Column:
    """body of the value, which is worked out once: what a lambda names is worked out for each element otherwise."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hash(key: str, kind: str, turn: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), other.cast("string")), 512)


def _turns(start: Column, step) -> Column:
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permuted_number(left: Column, right: Column, sizes: tuple[int, int], key: str, kind: str) -> Column:
    """struct(l, r): a permutation of the pairs with 0 <= left < sizes[0] and 0 <= right < sizes[1]."""
    number = lambda turn, other, size: F.conv(F.substring(_hash(key, kind, turn, other), 1, 14), 16, 10).cast("bigint") % size

    def step(s: Column, turn: Column) -> Column:
        a = F.struct(((s["l"] + number(turn, s["r"], sizes[0])) % sizes[0]).alias("l"), s["r"].alias("r"))
        b = F.struct(s["l"].alias("l"), ((s["r"] + number(turn, s["l"], sizes[1])) % sizes[1]).alias("r"))
        return F.when(turn % 2 == 0, a).otherwise(b)

    return _turns(F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r")), step)


def _moved(half: Column, stream: Column, hexes: bool) -> Column:
    """Each letter or digit of half moved within its alphabet by the stream's next two hex digits."""
    letters = 6 if hexes else 26

    def move(c: Column, i: Column, stream: Column) -> Column:
        by = F.conv(F.substring(stream, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        at = F.ascii(c)
        turn = lambda first, size: F.char(first + (at - first + by) % size)
        return (
            F.when(at.between(48, 57), turn(48, 10)).when(at.between(97, 96 + letters), turn(97, letters))
            .when(at.between(65, 64 + letters), turn(65, letters)).otherwise(c)
        )

    return _let(stream, lambda by: F.array_join(F.transform(F.split(half, "", -1), lambda c, i: move(c, i, by)), ""))


def permuted_text(text: Column, key: str, kind: str, hexes: bool = False) -> Column:
    """A permutation of the texts with letters and digits in the same places."""
    n = F.floor(F.length(text) / 2).cast("int")
    tag = F.length(text).cast("string")

    def step(s: Column, turn: Column) -> Column:
        stream = lambda other: _hash(key, kind, turn, F.concat_ws("|", tag, other))
        a = F.struct(_moved(s["l"], stream(s["r"]), hexes).alias("l"), s["r"].alias("r"))
        b = F.struct(s["l"].alias("l"), _moved(s["r"], stream(s["l"]), hexes).alias("r"))
        return F.when(turn % 2 == 0, a).otherwise(b)

    start = F.struct(F.substring(text, F.lit(1), n).alias("l"), F.substring(text, n + 1, F.length(text)).alias("r"))
    done = _turns(start, step)
    return F.concat(done["l"], done["r"])


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, doubling every second digit from the right but one."""
    chars = F.split(F.reverse(digits), "", -1)
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    values = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(twice(c.cast("int"))))
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def _refilled(m: Column, bare: Column) -> Column:
    """m with its letters and digits replaced, in order, by those of bare; all else stays in its place."""
    fill = lambda c, i: F.when(
        c.rlike("[0-9A-Za-z]"), F.substring(bare, F.length(F.regexp_replace(F.substring(m, F.lit(1), i + 1), "[^0-9A-Za-z]", "")), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(m, "", -1), fill), "")


def _card(m: Column, key: str) -> Column:
    digits = _digits(m)
    body = permuted_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    return _refilled(m, F.concat(body, check.cast("string")))


def mod97(text: Column) -> Column:
    """The remainder of a string of digits and capitals (A is 10) on division by 97."""
    def add(s: Column, c: Column) -> Column:
        at = F.ascii(c)
        return F.when(at < 58, (s * 10 + at - 48) % 97).otherwise((s * 100 + at - 55) % 97)

    return F.aggregate(F.split(F.regexp_replace(text, "[^0-9A-Z]", ""), "", -1), F.lit(0), add)


def _iban(m: Column, key: str) -> Column:
    account = permuted_text(F.substring(F.replace(m, F.lit(" ")), F.lit(5), F.length(m)), key, "iban")
    country = F.substring(m, 1, 2)
    check = 98 - mod97(F.concat(account, country, F.lit("00")))
    return _refilled(m, F.concat(country, F.lpad(check.cast("string"), 2, "0"), account))


def _number(m: Column, at: int, size: int) -> Column:
    return F.substring(m, at, size).cast("bigint")


def _ssn(m: Column, key: str) -> Column:
    # Areas are 001 to 899 without 666; groups 01 to 99; serials 0001 to 9999.
    area = _number(m, 1, 3)
    area = F.when(area > 666, area - 2).otherwise(area - 1)
    p = permuted_number(area, (_number(m, 5, 2) - 1) * 9999 + _number(m, 8, 4) - 1, (898, 99 * 9999), key, "ssn")
    area = F.when(p["l"] >= 665, p["l"] + 2).otherwise(p["l"] + 1)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.concat_ws("-", pad(area, 3), pad(F.floor(p["r"] / 9999) + 1, 2), pad(p["r"] % 9999 + 1, 4))


def _ipv4(m: Column, key: str) -> Column:
    part = lambda k: F.split(m, r"\.", -1)[k].cast("bigint")
    p = permuted_number(part(0) * 256 + part(1), part(2) * 256 + part(3), (65536, 65536), key, "ipv4")
    return F.concat_ws(".", *(x.cast("string") for h in ("l", "r") for x in (F.floor(p[h] / 256), p[h] % 256)))


_FORMATS = (("^[0-9]{4}-", "yyyy-MM-dd"), (r"^[0-9]{2}\.", "dd.MM.yyyy"), ("^[0-9]{2}/", "MM/dd/yyyy"))


def _day(m: Column) -> Column:
    """The date's day number, 0 for 1900-01-01; null for no existing day of 1900 to 2099."""
    date = F.coalesce(*(F.when(m.rlike(p), F.try_to_date(m, f)) for p, f in _FORMATS))
    day = F.datediff(date, F.lit("1900-01-01").cast("date"))
    return F.when(day.between(0, _DAYS[0] * _DAYS[1] - 1), day)


def _date(m: Column, key: str) -> Column:
    p = permuted_number(F.floor(_day(m) / _DAYS[1]), _day(m) % _DAYS[1], _DAYS, key, "date")
    date = F.date_add(F.lit("1900-01-01").cast("date"), (p["l"] * _DAYS[1] + p["r"]).cast("int"))
    return F.coalesce(*(F.when(m.rlike(pattern), F.date_format(date, f)) for pattern, f in _FORMATS))


#: The country codes of one and two digits; all others have three.
_COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def _phone(m: Column, key: str) -> Column:
    country = _digits(F.regexp_extract(m, _COUNTRY, 0))
    own = F.substring(_digits(m), F.length(country) + 1, F.length(m))
    return _refilled(m, F.concat(country, permuted_text(own, key, "phone")))


def _email(m: Column, key: str) -> Column:
    name = F.substring_index(m, "@", 1)
    new = F.split(permuted_text(F.lower(name), key, "email"), "", -1)
    cased = F.zip_with(F.split(name, "", -1), new, lambda old, c: F.when(old.rlike("[A-Z]"), F.upper(c)).otherwise(c))
    return F.concat(F.array_join(cased, ""), F.substring(m, F.length(name) + 1, F.length(m)))


def _token(m: Column, key: str) -> Column:
    name = F.regexp_extract(m, "^" + _SECRET, 0)
    value = F.substring(m, F.length(name) + 1, F.length(m))
    hexes = value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    return F.concat(name, F.when(hexes, permuted_text(value, key, "hex", True)).otherwise(permuted_text(value, key, "token")))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


#: Kind -> (validation, pseudonym) of a match.
_KINDS = {
    "token": (lambda m: F.lit(True), _token),
    "email": (lambda m: F.lit(True), _email),
    "iban": (lambda m: mod97(F.concat(F.substring(m, F.lit(5), F.length(m)), F.substring(m, 1, 4))) == 1, _iban),
    "date": (lambda m: _day(m).isNotNull(), _date),
    "ssn": (lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), _ssn),
    "ipv4": (lambda m: ~F.exists(F.split(m, r"\.", -1), lambda x: x.cast("int") > 255), _ipv4),
    "phone": (lambda m: F.length(_digits(m)).between(7, 15), _phone),
    "card": (lambda m: luhn_sum(_digits(m)) % 10 == 0, _card),
}


#: The shortest value of the kinds whose test is dear.
_LEAST = {"iban": 12, "card": 13}


def kind_of(m: Column) -> Column:
    """The kind of a match that is valid, else null."""
    found = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        fits = m.rlike(f"^(?:{pattern})$") & _KINDS[kind][0](m)
        found = F.when((F.length(m) >= _LEAST[kind]) & fits if kind in _LEAST else fits, F.lit(kind)).otherwise(found)
    return found


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a match of the kind; without a kind the match itself."""
    out = m
    for name, (_, permute) in _KINDS.items():
        out = F.when(kind == name, permute(m, key)).otherwise(out)
    return out


#: Characters of the shortest and the longest value that a run of groups can be: an address and an account in groups.
_SPAN = (7, 43)


def _spans(m: Column) -> Column:
    """array<struct(m, kind)>, together m: the valid values among the groups of a match that is none itself. A match of
    groups has a bounded length, so this takes a bounded time for each."""
    part = lambda text, kind: F.struct(text.alias("m"), kind.cast("string").alias("kind"))

    def of(groups: Column) -> Column:
        last = F.size(groups) - 1

        def step(s: Column, i: Column) -> Column:
            text = lambda j: F.array_join(F.slice(groups, i + 1, j - i + 1), "")
            bare = lambda j: F.struct(j.alias("j"), F.regexp_replace(text(j), r"[ \-]+$", "").alias("m"))
            some = F.filter(F.transform(F.sequence(i, last), bare), lambda x: F.length(x["m"]).between(*_SPAN))
            known = F.transform(some, lambda x: F.struct(x["j"].alias("j"), x["m"].alias("m"), kind_of(x["m"]).alias("kind")))

            def longest(found: Column) -> Column:
                x = F.get(found, F.size(found) - 1)
                rest = F.substring(text(x["j"]), F.length(x["m"]) + 1, F.length(m))
                hit = F.struct((x["j"] + 1).alias("next"), F.concat(s["out"], F.array(part(x["m"], x["kind"]), part(rest, F.lit(None)))).alias("out"))
                miss = F.struct((i + 1).alias("next"), F.concat(s["out"], F.array(part(F.element_at(groups, i + 1), F.lit(None)))).alias("out"))
                return F.when(F.size(found) > 0, hit).otherwise(miss)

            return F.when(i < s["next"], s).otherwise(_let(F.filter(known, lambda x: x["kind"].isNotNull()), longest))

        start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<m:string,kind:string>>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), last), start, step)["out"]

    return _let(F.regexp_extract_all(m, F.lit(r"[^ \-]+[ \-]*|[ \-]+"), 0), of)


def pseudonymised(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """df with its text column rewritten, and pii added: an array of the kinds replaced, in their order."""
    body = F.col(text)
    matches = F.when(body.rlike("[0-9@=:]"), F.regexp_extract_all(body, F.lit(_ANY), 0))
    found = df.withColumn("__found", F.transform(matches, lambda x: F.struct(x.alias("m"), kind_of(x).alias("kind"))))
    whole = lambda x: x["kind"].isNotNull() | ~F.rlike(x["m"], F.lit(r"[^ \-][ \-]"))
    found = found.withColumn("__found", F.transform("__found", lambda x: F.when(whole(x), F.array(x)).otherwise(_spans(x["m"]))))
    new = lambda parts: F.array_join(F.transform(parts, lambda x: pseudonym(x["m"], x["kind"], key)), "")
    pieces = F.zip_with(F.split(body, _ANY, -1), F.transform("__found", new), lambda p, q: F.concat(p, F.coalesce(q, F.lit(""))))
    kinds = F.filter(F.transform(F.flatten("__found"), lambda x: x["kind"]), lambda k: k.isNotNull())
    any_kind = F.size(F.coalesce(kinds, F.array().cast("array<string>"))) > 0
    return found.withColumns({
        text: F.when(any_kind, F.array_join(pieces, "")).otherwise(body),
        "pii": F.coalesce(kinds, F.array().cast("array<string>")),
    }).drop("__found")
