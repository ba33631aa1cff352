"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Matches of one pattern are validated by kind, and each valid value goes through a keyed Feistel permutation of its own format: equal values get
equal pseudonyms in all documents, different values of a kind different ones, and a pseudonym is valid again.

* cards (13 to 19 digits, Luhn): all digits but the last are permuted, the check digit follows
* bank accounts (IBAN, modulo 97): letters and digits after the check digits are permuted, which then follow
* phone numbers (North American plan), social security numbers, IPv4 addresses: permuted within the valid numbers
* dates (year-month-day, also before a time, day/month/year, day.month.year, years 1900 to 2099): permuted within these 200 years; month/day/year where
  day/month/year is no date: permuted among the dates of which this holds
* e-mail addresses: letters and digits before the last dot are permuted, each within its class

Digit groups joined by single spaces or hyphens, and what follows an account number so, are one match and may hold several values. From left to right,
the longest valid span of whole groups is taken that is a card in a usual form (unbroken, 4-4-4-4, 4-6-5 and 4-6-4 groups) or of another kind; where there
is none, all groups together may be a card in other groups. Of two valid readings that overlap, only the first is taken.

Matches that are not valid stay, as does all other text. Null texts stay null, empty ones empty. Every row is handled on its own, so repeated rows, ties,
null ids and empty tables need no rule. All columns pass through; ``n_pii`` replaces a column so named. The key is the caller's secret.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.llm.common import free_name

ROUNDS = 10
FIRST_DAY = "1900-01-01"
#: 17 * 4297 = 73049 days are the years 1900 to 2099.
DAYS = (17, 4297)

# The patterns of the kinds.
#: A domain has 127 labels at most; the bound also keeps the loop over them, which nests in Java, off the end of the stack.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,125}\.[A-Za-z]{2,}"
PHONE = r"(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}"
SSN = r"\d{3}-\d{2}-\d{4}"
DATE = r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}"
IP = r"\d{1,3}(?:\.\d{1,3}){3}"
CARD = r"\d(?:[ -]?\d){12,18}"
#: Cards as they are usually written.
USUAL = r"\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{4,5}"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
#: A group of digits that begins no dotted or slashed value, time stamp or e-mail address.
GROUP = r"(?!\d{4}-\d{2}-\d{2}T)\d++(?![A-Za-z]|[./]\d|[A-Za-z0-9._%+-]{0,64}@)"
FORMS = f"{USUAL}|{PHONE}|{SSN}|{DATE}|{IBAN}"
MORE = f"(?:[ -]{GROUP})*+"
RUN = rf"(?=\d(?:[ -]?\d){{12}}){GROUP}{MORE}"
STAMP = r"\d{4}-\d{2}-\d{2}(?=T\d)"
ANY = (f"{EMAIL}|(?<![A-Za-z0-9.+])(?:{STAMP}|(?:{PHONE}|{SSN}|{DATE}|{IP})(?![A-Za-z0-9]|\\.\\d)|{RUN}|{IBAN}(?![A-Za-z0-9]|[./]\\d){MORE})")
#: Groups that an account number has at most; other values have fewer.
GROUPS = 10


def _full(value: Column, pattern: str) -> Column:
    return value.rlike(f"^(?:{pattern})$")


def _digest(key: str, kind: str, round_: Column, value: Column) -> Column:
    """Hex digits that the key, the round and the value determine: a hash of a hash, both with the key."""
    inner = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), round_.cast("string"), value.cast("string")), 256)
    return F.sha2(F.concat_ws("|", F.lit(key), inner), 256)


def _number(hexes: Column) -> Column:
    return F.conv(F.substring(hexes, 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, m: Column | int, n: Column | int, key: str, kind: str) -> Column:
    """Permutes the pairs of numbers (a below m, b below n): in turn, each gets added a hash of the other."""
    m, n = (F.lit(v).cast("long") if isinstance(v, int) else v.cast("long") for v in (m, n))
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def turn(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, (acc["a"] + _number(_digest(key, kind, i, acc["b"])) % m) % m).otherwise(acc["a"]).alias("a"),
                        F.when(even, acc["b"]).otherwise((acc["b"] + _number(_digest(key, kind, i, acc["a"])) % n) % n).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _shifted(text: Column, hexes: Column) -> Column:
    """Letters and digits moved within their class by two hex digits each; other characters stay."""
    def one(c: Column, i: Column) -> Column:
        by = F.conv(F.substr(hexes, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        code = F.ascii(c)
        move = lambda base, size: F.char(F.lit(base) + (code - base + by) % size)
        return F.when(c.rlike("^[0-9]$"), move(48, 10)).when(c.rlike("^[a-z]$"), move(97, 26)).when(c.rlike("^[A-Z]$"), move(65, 26)).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def feistel_text(text: Column, key: str, kind: str) -> Column:
    """Permutes letters and digits of a text in place: its halves are moved in turn by a hash of the other."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("a"), F.substr(text, half + 1, F.length(text)).alias("b"))

    def turn(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, _shifted(acc["a"], _digest(key, kind, i, acc["b"]))).otherwise(acc["a"]).alias("a"),
                        F.when(even, acc["b"]).otherwise(_shifted(acc["b"], _digest(key, kind, i, acc["a"]))).alias("b"))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
    return F.transform(F.array(done), lambda d: F.concat(d["a"], d["b"]))[0]


def _with(value: Column, fn) -> Column:
    """fn(value), where the value is computed once however often fn uses it."""
    return F.transform(F.array(value), fn)[0]


def _refill(shape: Column, chars: Column, pattern: str) -> Column:
    """``shape`` with its characters of the class replaced, in order, by ``chars``."""
    def one(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substr(shape, F.lit(1), i), f"[^{pattern}]", ""))
        return F.when(c.rlike(f"^[{pattern}]$"), F.substr(chars, before + 1, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(shape, ""), lambda c: c != ""), one), "")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _ten_to(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def _card(m: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        size = F.length(d) - 1
        left = F.floor(size / 2).cast("int")
        mixed = feistel(F.substr(d, F.lit(1), left), F.substr(d, left + 1, size - left), _ten_to(left), _ten_to(size - left), key, "card")
        front = _with(mixed, lambda s: F.concat(F.lpad(s["a"].cast("string"), left, "0"), F.lpad(s["b"].cast("string"), size - left, "0")))
        ends = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.concat(front, c.cast("string")))
        return _refill(m, F.filter(ends, _luhn)[0], "0-9")

    return _with(_digits(m), made)


def _phone(m: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        area, office, line = (F.substr(d, F.lit(i), F.lit(n)).cast("long") for i, n in ((1, 3), (4, 3), (7, 4)))
        mixed = feistel((area - 200) * 800 + office - 200, line, 640_000, 10_000, key, "phone")
        new = _with(mixed, lambda s: F.concat((F.floor(s["a"] / 800) + 200).cast("string"), (s["a"] % 800 + 200).cast("string"),
                                              F.lpad(s["b"].cast("string"), 4, "0")))
        return _refill(m, F.concat(F.substr(_digits(m), F.lit(1), F.length(_digits(m)) - 10), new), "0-9")

    return _with(F.substr(_digits(m), F.length(_digits(m)) - 9, F.lit(10)), made)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substr(m, F.lit(i), F.lit(n)).cast("long") for i, n in ((1, 3), (5, 2), (8, 4)))
    place = F.when(area > 666, area - 2).otherwise(area - 1)  # 001 to 899 without 666
    mixed = feistel(place * 99 + group - 1, serial - 1, 898 * 99, 9_999, key, "ssn")

    def text(s: Column) -> Column:
        at = F.floor(s["a"] / 99)
        return F.concat_ws("-", F.lpad((at + F.when(at >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
                           F.lpad((s["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((s["b"] + 1).cast("string"), 4, "0"))

    return _with(mixed, text)


def _ip(m: Column, key: str) -> Column:
    def made(o: Column) -> Column:
        part = lambda i: o[i].cast("long")
        mixed = feistel(part(0) * 256 + part(1), part(2) * 256 + part(3), 65_536, 65_536, key, "ip")
        return _with(mixed, lambda s: F.concat_ws(".", *((F.floor(s[h] / 256) if high else s[h] % 256).cast("string") for h in "ab" for high in (True, False))))

    return _with(F.split(m, r"\."), made)


def _iso(m: Column) -> Column:
    part = lambda i, n: F.substr(m, F.lit(i), F.lit(n))
    return F.when(m.rlike(r"^\d{4}-"), m).otherwise(F.concat_ws("-", part(7, 4), part(4, 2), part(1, 2)))


def _month_first(m: Column) -> Column:
    """Whether a slashed date is one with the month first only."""
    return m.contains("/") & F.try_to_date(_iso(m), "yyyy-MM-dd").isNull()


def _day(m: Column) -> Column:
    """The date, null where there is no such day."""
    part = lambda i, n: F.substr(m, F.lit(i), F.lit(n))
    return F.coalesce(F.try_to_date(_iso(m), "yyyy-MM-dd"),
                      F.when(m.contains("/"), F.try_to_date(F.concat_ws("-", part(7, 4), part(1, 2), part(4, 2)), "yyyy-MM-dd")))


def _date(m: Column, key: str) -> Column:
    on = lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))

    def permuted(n: Column, kind: str) -> Column:
        return _with(feistel(F.floor(n / DAYS[1]), n % DAYS[1], *DAYS, key, kind), lambda s: s["a"] * DAYS[1] + s["b"])

    def other(n: Column) -> Column:
        """The next day in the cycle that has no place as a month; six in ten have none, so 100 steps always reach one."""
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(100)), permuted(n, "month-first"),
                             lambda acc, _: F.when(F.dayofmonth(on(acc)) > 12, acc).otherwise(permuted(acc, "month-first")))
        return F.date_format(on(walked), "MM/dd/yyyy")

    def made(n: Column) -> Column:
        return F.when(_month_first(m), other(n)).otherwise(
            _with(_with(permuted(n, "date"), on),
                  lambda d: F.when(m.contains("-"), F.date_format(d, "yyyy-MM-dd")).when(m.contains("/"), F.date_format(d, "dd/MM/yyyy"))
                  .otherwise(F.date_format(d, "dd.MM.yyyy"))))

    return _with(F.date_diff(_day(m), F.lit(FIRST_DAY).cast("date")).cast("long"), made)


def _mod_97(text: Column) -> Column:
    """Letters count as 10 to 35, and all digits together as one number, modulo 97."""
    def add(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def _plain(m: Column) -> Column:
    return F.regexp_replace(m, " ", "")


def _iban(m: Column, key: str) -> Column:
    def made(p: Column) -> Column:
        land = F.substr(p, F.lit(1), F.lit(2))
        rest = feistel_text(F.substr(p, F.lit(5), F.length(p)), key, "iban")
        return _refill(m, _with(rest, lambda r: F.concat(land, F.lpad((98 - _mod_97(F.concat(r, land, F.lit("00")))).cast("string"), 2, "0"), r)), "A-Z0-9")

    return _with(_plain(m), made)


def _email(m: Column, key: str) -> Column:
    cut = F.length(F.regexp_extract(m, r"^(.*)\.[A-Za-z]+$", 1))
    return F.concat(feistel_text(F.substr(m, F.lit(1), cut), key, "email"), F.substr(m, cut + 1, F.length(m)))


def kind(m: Column) -> Column:
    """The kind of a match, null unless it is valid."""
    digits = F.length(_digits(m))
    octets = F.split(m, r"\.")
    area = F.substr(m, F.lit(1), F.lit(3))
    return (F.when(m.contains("@"), "email")
            .when(_full(m, PHONE), "phone")
            .when(_full(m, SSN), F.when(~area.isin("000", "666") & (area < "900") & ~m.rlike("-00-|-0000$"), "ssn"))
            .when(_full(m, DATE), F.when(F.year(_day(m)).between(1900, 2099), "date"))
            .when(_full(m, IP), F.when(F.forall(octets, lambda o: (o.cast("int") <= 255) & ~o.rlike("^0.")), "ip"))
            .when(_full(m, CARD), F.when(digits.between(13, 19) & _luhn(_digits(m)), "card"))
            .when(_full(m, IBAN), F.when(_with(_plain(m), lambda p: _mod_97(F.concat(F.substr(p, F.lit(5), F.length(p)), F.substr(p, F.lit(1), F.lit(4)))) == 1), "iban")))


def pseudonym(m: Column, k: Column, key: str) -> Column:
    out = F.when(k.isNull(), m)
    for name, fn in (("email", _email), ("phone", _phone), ("ssn", _ssn), ("date", _date), ("ip", _ip), ("card", _card), ("iban", _iban)):
        out = out.when(k == name, fn(m, key))
    return out


def _piece(m: Column, k: Column) -> Column:
    return F.struct(m.alias("m"), k.cast("string").alias("k"))


def _values(m: Column) -> Column:
    """The values of a match of several groups, and the text between them (kind null), in order."""
    def best(i: Column, groups: Column) -> Column:
        """The longest valid span from group i on: last group, text, kind; null if none is valid."""
        ends = F.sequence(i, F.least(i + GROUPS - 1, F.size(groups) - 1))
        texts = F.transform(ends, lambda j: F.struct(j.alias("j"), F.regexp_replace(F.array_join(F.slice(groups, i + 1, j - i + 1), ""), "^[ -]", "").alias("m")))
        texts = F.filter(texts, lambda t: F.length(t["m"]).between(9, 42) & _full(t["m"], FORMS))
        return F.array_max(F.filter(F.transform(texts, lambda t: F.struct(t["j"].alias("j"), t["m"].alias("m"), kind(t["m"]).alias("k"))), lambda t: t["k"].isNotNull()))

    def found(groups: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(groups) - 1), lambda i: F.struct(i.alias("i"), best(i, groups).alias("b")))
        return F.filter(each, lambda s: s["b"].isNotNull())

    def picked(valid: Column) -> Column:
        """Those that begin behind the end of the last one picked."""
        start = F.struct(F.lit(-1).alias("last"), F.filter(valid, lambda _: F.lit(False)).alias("all"))
        return F.aggregate(valid, start, lambda acc, s: F.when(s["i"] > acc["last"], F.struct(s["b"]["j"].alias("last"), F.concat(acc["all"], F.array(s)).alias("all")))
                           .otherwise(acc), lambda acc: acc["all"])

    def cut(groups: Column, chosen: Column) -> Column:
        def one(g: Column, i: Column) -> Column:
            here = F.filter(chosen, lambda s: (s["i"] <= i) & (i <= s["b"]["j"]))
            return _with(here, lambda h: F.when(F.size(h) == 0, F.array(_piece(g, F.lit(None))))
                         .when(h[0]["i"] == i, F.array(_piece(F.regexp_extract(g, "^[ -]?", 0), F.lit(None)), _piece(h[0]["b"]["m"], h[0]["b"]["k"])))
                         .otherwise(F.array(_piece(F.lit(""), F.lit(None)))))

        return F.flatten(F.transform(groups, one))

    groups = F.regexp_extract_all(m, F.lit("[ -]?[A-Z0-9]+"), F.lit(0))
    return _with(groups, lambda g: _with(_with(found(g), picked), lambda c: F.when(F.size(c) > 0, cut(g, c)).otherwise(F.array(_piece(m, kind(m))))))


def _pieces(m: Column) -> Column:
    """A match as values and text between them."""
    groups = m.rlike("^(?:[0-9]+|[A-Z]{2}[0-9]{2}[A-Z0-9]*)[ -]") & (F.length(m) > 13) & ~_full(m, USUAL)
    return F.when(groups, _values(m)).otherwise(F.array(_piece(m, kind(m))))


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in the text; ``n_pii`` counts them."""
    text = F.col(f"`{text_col}`")
    raw, named_ = free_name(docs, "_found"), free_name(docs, "_named")
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    pieces = F.split(text, ANY, -1)
    new = F.concat(F.transform(named_, lambda found: F.array_join(F.transform(found, lambda x: pseudonym(x["m"], x["k"], key)), "")), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(pieces, new, lambda p, m: F.concat(p, m)), "")
    valid = F.filter(F.flatten(named_), lambda x: x["k"].isNotNull())
    some = F.size(valid) > 0
    return (docs.drop("n_pii").withColumn(raw, found).withColumn(named_, F.transform(raw, _pieces))
            .withColumn(text_col, F.when(some, joined).otherwise(text))
            .withColumn("n_pii", F.coalesce(F.size(valid), F.lit(0)).cast("long"))
            .drop(raw, named_))
