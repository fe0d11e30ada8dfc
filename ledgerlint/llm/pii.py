"""Personal data and secrets: found by pattern, validated, and replaced by pseudonyms of the same format.

Numbers and dates go through a keyed Feistel permutation of their own format: card numbers keep their first digit and
get a new check digit, account numbers (IBAN) keep country and letters and get new check digits, social security
numbers and addresses stay possible ones, dates stay dates, phone numbers keep their country code or leading zero. A permutation maps
equal values to equal values in every document and different ones to different ones, and whoever has the key can undo
it. Names in mail addresses and secrets have no format to permute: their letters and digits are replaced by a keyed hash,
class by class, which links equal values as well.

A number that fails its check (Luhn, mod 97, ranges, calendar) is not personal data and stays. One pass splits a text at
the pattern and one collects the matches; both are joined again. Rows without digits and without ``@`` skip both.
All of it is column expressions on single rows: nothing is shuffled.

Defined cases: NULL text stays NULL with no findings; empty tables, repeated rows and NULLs in other columns stay as
they are; all other columns are kept, and result columns that clash with one of the input replace it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlint.llm.common import lower_ascii

ROUNDS = 8
#: The first and the number of days of the permuted calendar: 1900-01-01 to 2099-12-31.
FIRST_DAY, DAYS = "1900-01-01", 73049

MAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}"
SECRET = r"(?<![A-Za-z0-9_])(?i:token|secret|password|passwd|api_?key)\s?[=:]\s?[\"']?[A-Za-z0-9+/_.-]{8,}+[\"']?"
CLOUD_KEY = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}+(?: [A-Z0-9]{1,3}+)?)(?![A-Za-z0-9])"
DATE = r"(?<![\d.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?!\d|[.-]\d)"
ADDRESS = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<![\d-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?![\d-])"
PHONE = r"(?:(?<![\d+])\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)"
#: Without a country code: separated in threes and fours, or with a leading zero.
NATIONAL = (r"(?<![\d.+/-])(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|0\d{1,4}[ /]\d{3,8}(?: \d{3,4})?)(?![\d.-]?\d|/\d)")
PATTERN = "|".join([MAIL, SECRET, CLOUD_KEY, IBAN, DATE, ADDRESS, SOCIAL, CARD, PHONE, NATIONAL])


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _only(m: Column, keep: str) -> Column:
    return F.regexp_replace(m, f"[^{keep}]", "")


def _number(parts: list, modulus: Column) -> Column:
    """A number below ``modulus`` from a keyed hash of ``parts``."""
    hashed = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    return F.pmod(F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long"), modulus)


def _feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, tweak: str) -> Column:
    """Eight rounds on a pair of numbers below the two sizes: each side in turn is shifted by a hash of the other."""
    def turn(s: Column, i: Column) -> Column:
        def shifted(one: str, other: str, size: Column) -> Column:
            return F.pmod(s[one] + _number([F.lit(key), F.lit(tweak), left_size, right_size, i, s[other]], size), size)
        even = i % 2 == 0
        return F.struct(F.when(even, shifted("l", "r", left_size)).otherwise(s["l"]).alias("l"),
                        F.when(even, s["r"]).otherwise(shifted("r", "l", right_size)).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _size(digits: Column) -> Column:
    return F.rpad(F.lit("1"), (digits + 1).cast("int"), F.lit("0")).cast("long")


def permuted_digits(digits: Column, key: str, tweak: str) -> Column:
    """A digit string of 2 to 36 digits, permuted among those of its length; shorter ones stay."""
    def halves(d: Column) -> Column:
        a = F.floor(F.length(d) / 2).cast("int")
        b = F.length(d) - a
        mixed = _feistel(F.substr(d, F.lit(1), a), F.substr(d, a + 1, b), _size(a), _size(b), key, tweak)
        return _let(mixed, lambda x: F.concat(F.lpad(x["l"].cast("string"), a, "0"), F.lpad(x["r"].cast("string"), b, "0")))
    return F.when(F.length(digits) < 2, digits).otherwise(_let(digits, halves))


def _fill(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced by ``digits`` in order; all other characters stay."""
    each = F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: _let(F.substr(m, i, F.lit(1)), lambda c: F.when(
        c.rlike("[0-9]"), F.substr(digits, F.length(_only(F.substr(m, F.lit(1), i), "0-9")), F.lit(1))).otherwise(c)))
    return F.array_join(each, "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string, modulo 10."""
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = 2 * d - F.when(d > 4, F.lit(9)).otherwise(0)
        return F.when(i % 2 == 1, twice).otherwise(d)
    each = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), value)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def _mod97(account: Column) -> Column:
    """The remainder of an IBAN by 97, letters read as 10 to 35 and the first four characters last."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substring(account, 1, 4))
    def step(rest: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)


def _masked(value: Column, key: str, tweak: str) -> Column:
    """Letters and digits of ``value`` replaced by those of a keyed hash: digits by digits, letters by letters of the
    same case (a-f if the value is hexadecimal); other characters stay."""
    def one(hashed: Column) -> Column:
        letters = F.when(lower_ascii(value).rlike("^[0-9a-f]+$"), F.lit(6)).otherwise(F.lit(26))
        def put(i: Column) -> Column:
            def by_class(c: Column) -> Column:
                n = F.conv(F.substr(hashed, 2 * ((i - 1) % 64) + 1, F.lit(2)), 16, 10).cast("int")
                return (F.when(c.rlike("[0-9]"), (n % 10).cast("string"))
                        .when(c.rlike("[A-Z]"), F.char(F.lit(65) + n % letters))
                        .when(c.rlike(r"\p{L}"), F.char(F.lit(97) + n % letters)).otherwise(c))
            return _let(F.substr(value, i, F.lit(1)), by_class)
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), put), "")
    return F.when(F.length(value) == 0, value).otherwise(
        _let(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), value), 512), one))


def _new_card(m: Column, key: str) -> Column:
    def body(d: Column) -> Column:
        inner = permuted_digits(F.substr(d, F.lit(2), F.length(d) - 2), key, "card")
        return _let(F.concat(F.substring(d, 1, 1), inner), lambda x: F.concat(
            x, F.pmod(10 - _luhn(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")))
    return _fill(m, _let(_only(m, "0-9"), body))


def _new_account(m: Column, key: str) -> Column:
    def body(a: Column) -> Column:
        digits = permuted_digits(_only(F.substr(a, F.lit(5)), "0-9"), key, "account")
        blank = F.concat(F.substring(a, 1, 2), F.lit("00"))
        filled = _fill(F.substr(a, F.lit(5)), digits)
        return _let(F.concat(blank, filled), lambda x: F.concat(
            F.lpad((98 - _mod97(x)).cast("string"), 2, "0"), digits))
    return _fill(m, _let(_only(m, "A-Z0-9"), body))


def _octets(m: Column) -> Column:
    return F.transform(F.split(m, r"\."), lambda x: x.cast("int"))


def _new_address(m: Column, key: str) -> Column:
    def body(o: Column) -> Column:
        mixed = _feistel(F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)), F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)),
                         F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, "address")
        return _let(mixed, lambda x: F.concat_ws(".", *[
            c.cast("long").cast("string") for c in (
                F.floor(x["l"] / 256), x["l"] % 256, F.floor(x["r"] / 256), x["r"] % 256)]))
    return _let(_octets(m), body)


def _walk(first: Column, possible, once) -> Column:
    """Apply ``once`` until the value is possible: a permutation of the possible values. Fifty steps miss one value in
    more than 10**8 at the shares used here; such a value stays as it is."""
    def step(s: Column, _: Column) -> Column:
        return F.when(possible(s) & s["moved"], s).otherwise(_let(once(s), lambda x: x))
    return F.aggregate(F.sequence(F.lit(1), F.lit(50)), first, step)


def _new_social(m: Column, key: str) -> Column:
    def state(digits: Column, moved: bool) -> Column:
        return F.struct(digits.alias("d"), F.lit(moved).alias("moved"))
    def possible(s: Column) -> Column:
        return _possible_social(s["d"])
    end = _walk(state(_only(m, "0-9"), False), possible, lambda s: state(permuted_digits(s["d"], key, "social"), True))
    return _let(end, lambda s: F.when(possible(s), _fill(m, s["d"])).otherwise(m))


def _possible_social(digits: Column) -> Column:
    area = F.substring(digits, 1, 3).cast("int")
    return ((area > 0) & (area < 900) & (area != 666) & (F.substring(digits, 4, 2) != "00")
            & (F.substring(digits, 6, 4) != "0000"))


def _day(m: Column) -> Column:
    """Days since the first day of the calendar, NULL for what is no date in it; day before month where it is written
    in front, and month before day where only that is possible."""
    day_first = F.coalesce(*[F.try_to_timestamp(m, F.lit(f)) for f in ("yyyy-MM-dd", "d.M.yyyy", "d/M/yyyy",
                                                                     "M/d/yyyy")]).cast("date")
    n = F.datediff(day_first, F.lit(FIRST_DAY).cast("date"))
    return F.when((n >= 0) & (n < DAYS), n)


def _new_date(m: Column, key: str) -> Column:
    side = F.lit(271).cast("long")  # 271 * 271 is little more than the number of days
    def state(n: Column, moved: bool) -> Column:
        return F.struct(n.cast("long").alias("n"), F.lit(moved).alias("moved"))
    def once(s: Column) -> Column:
        mixed = _feistel(F.floor(s["n"] / 271), s["n"] % 271, side, side, key, "date")
        return _let(mixed, lambda x: state(x["l"] * 271 + x["r"], True))
    end = _walk(state(_day(m), False), lambda s: s["n"] < DAYS, once)
    def written(s: Column) -> Column:
        date = F.date_add(F.lit(FIRST_DAY).cast("date"), s["n"].cast("int"))
        month_first = F.try_to_timestamp(m, F.lit("d/M/yyyy")).isNull()
        padded = m.rlike(r"^\d{2}[./]\d{2}[./]")

        def as_written(long: str, short: str) -> Column:
            return F.when(padded, F.date_format(date, long)).otherwise(F.date_format(date, short))

        return (F.when(m.rlike("^.{4}-"), F.date_format(date, "yyyy-MM-dd"))
                .when(m.rlike(r"\."), as_written("dd.MM.yyyy", "d.M.yyyy"))
                .when(month_first, as_written("MM/dd/yyyy", "M/d/yyyy")).otherwise(as_written("dd/MM/yyyy", "d/M/yyyy")))
    return _let(end, written)


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def kind(m: Column) -> Column:
    """What a match is, NULL if it fails its check."""
    digits = _only(m, "0-9")
    return (
        F.when(m.contains("@") & m.rlike(_whole(MAIL)), "mail")
        .when(m.rlike(_whole(SECRET)) | m.rlike(_whole(CLOUD_KEY)), "secret")
        .when(m.rlike(_whole(IBAN)), F.when(_mod97(_only(m, "A-Z0-9")) == 1, "account"))
        .when(m.rlike(_whole(DATE)), F.when(_day(m).isNotNull(), "date"))
        .when(m.rlike(_whole(ADDRESS)), F.when(F.forall(_octets(m), lambda x: x < 256), "address"))
        .when(m.rlike(_whole(SOCIAL)), F.when(_possible_social(digits), "social"))
        .when(m.rlike(_whole(CARD)), F.when((_luhn(digits) == 0) & ~digits.rlike("^0+$"), "card"))
        .when(F.length(digits).between(8, 15), "phone")
    )


def pseudonym(m: Column, of: Column, key: str) -> Column:
    """The pseudonym of a match of the given kind."""
    phone_code = F.regexp_extract(m, r"^(?:\+\d{1,3}(?=[ .(-])|0)", 0)
    phone = _let(phone_code, lambda c: F.concat(c, _let(F.substr(m, F.length(c) + 1), lambda rest: _fill(
        rest, permuted_digits(_only(rest, "0-9"), key, "phone")))))
    secret = F.regexp_extract(m, r"^(?:AKIA|ASIA|(?i:token|secret|password|passwd|api_?key)\s?[=:]\s?[\"']?)", 0)
    return (
        F.when(of == "mail", F.concat(_masked(F.substring_index(m, "@", 1), key, "mail"), F.lit("@"),
                                      F.substring_index(m, "@", -1)))
        .when(of == "secret", _let(secret, lambda s: F.concat(s, _masked(F.substr(m, F.length(s) + 1), key, "secret"))))
        .when(of == "account", _new_account(m, key)).when(of == "date", _new_date(m, key))
        .when(of == "address", _new_address(m, key)).when(of == "social", _new_social(m, key))
        .when(of == "card", _new_card(m, key)).when(of == "phone", phone).otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str | None = "found") -> DataFrame:
    """``docs`` with the text replaced by its pseudonymised form, and under ``found`` (unless None) the kinds of what
    was replaced, in order. ``key`` is the secret of the permutations."""
    possible = F.col(text).rlike("[0-9@]|(?i:token|secret|password|passwd|key)")
    staged = docs.withColumn("__found", F.when(possible, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))))
    named = F.transform("__found", lambda m: F.struct(m.alias("m"), kind(m).alias("kind")))
    staged = staged.withColumn("__found", named)
    new = F.transform("__found", lambda x: pseudonym(x["m"], x["kind"], key))
    gaps = F.split(F.col(text), PATTERN, -1)
    joined = F.array_join(F.flatten(F.zip_with(gaps, F.concat(new, F.array(F.lit(""))), lambda g, p: F.array(g, p))), "")
    kinds = F.coalesce(F.filter(F.transform("__found", lambda x: x["kind"]), lambda k: k.isNotNull()),
                       F.array().cast("array<string>"))
    anything = F.exists("__found", lambda x: x["kind"].isNotNull())
    columns = {c: F.col(f"`{c}`") for c in docs.columns}
    columns[text] = F.when(anything, joined).otherwise(F.col(text))
    if found:
        columns[found] = kinds
    return staged.select(*[value.alias(name) for name, value in columns.items()])


def report(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, pseudonymised text, ``n_found`` and ``kinds`` (sorted, comma-joined)."""
    out = pseudonymise(docs.select(F.col(key).alias(key), F.col(text).alias("text")), secret, "text", "__kinds")
    return out.select(key, "text", F.size("__kinds").cast("long").alias("n_found"),
                      F.array_join(F.array_sort(F.array_distinct("__kinds")), ",").alias("kinds"))
