"""Format-preserving Feistel pseudonyms for personal data, with DataFrame functions alone.

Numbers and dates that are valid (card numbers by their check digit, bank accounts by theirs, social security and phone
numbers by their plan, IPv4 addresses by their octets, dates by the calendar) are mapped to a pair of digits in mixed radix
and permuted by a keyed Feistel network over just those pairs, then written back in the same layout: the result is as valid
as the value was, equal values stay equal everywhere, and different values stay different. E-mail addresses and secrets,
which have no such domain, become keyed hashes. Texts without a sign of any form (``HINT``) are passed on without a closer
look. Four numbers joined by dots behind a v or a word for versions are no address.

The key decides all of it, and whoever has it can undo it: a deployment sets ``spark.tessera.pii.secret`` (a name that
Spark's own logs and pages redact; as a literal the key is in the plan too, for which spark.sql.redaction.string.regex is).
The demonstration key stands in for it only so that results can be compared.

Defined results: a null text stays null and an empty one empty; null doc_ids and repeated rows pass row by row; an empty
table gives no row; further columns stay as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import free_names, read_spread

SETTING = "spark.tessera.pii.secret"
DEMONSTRATION_KEY = "tessera demonstration key"
ROUNDS = 8

#: The forms looked for, most specific first.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"
#: Values behind a name; keys and tokens that their makers begin in a way of their own; signed tokens; private key blocks.
NAMED_SECRET = r"(?i:password|passwd|token|secret|api_key|apikey)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_+/=.-]{8,}+[\"']?"
BEARER = r"(?i:bearer)\s{1,3}[A-Za-z0-9_+/=.~-]{16,}+"
MARKED_SECRET = r"AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{16,}+|github_pat_[A-Za-z0-9_]{16,}+|sk-[A-Za-z0-9_-]{16,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[0-9A-Za-z_-]{30,}+|eyJ[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]++)++"
KEY_BLOCK = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?"
SECRET = rf"(?<![A-Za-z0-9_])(?:{MARKED_SECRET}|{NAMED_SECRET}|{BEARER})|{KEY_BLOCK}"
#: Groups behind blanks have a digit, so that capitals behind an account aren't taken for a part of it.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}(?:(?: (?=[A-Z]{0,3}[0-9]))?[A-Z0-9]{4}){1,6}(?:(?: (?=[A-Z]{0,2}[0-9]))?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IP = rf"(?=[0-9])(?<![0-9.vV])(?<!(?i:version|release|build)[ :=]{{1,2}})(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
ISO_DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
DAY_DATE = r"(?<![0-9./])[0-9]{2}(?:/[0-9]{2}/|\.[0-9]{2}\.)[0-9]{4}(?![0-9/])"
#: Numbers marked as phone numbers by +1 or by parentheses have any area code and exchange.
MARKED_PHONE = r"(?<![0-9+])(?:\+1[ .-]?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-]?)|(?:1[ .-]?)?\([0-9]{3}\)[ .-]?)[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
PHONE = r"(?<![0-9+])(?:1[ .-]?)?[2-9][0-9]{2}[ .-][2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])"
ABROAD = r"(?<![0-9+])\+[2-9][0-9]{0,2}(?:[ .-]?[0-9]){7,12}(?![0-9])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
#: No form is without one of these.
HINT = "[0-9@=:]|AKIA|gh[pousr]_|github_pat_|sk-|xox[abprs]-|AIza|eyJ|(?i:bearer)|-----BEGIN"
ANY = "|".join((EMAIL, SECRET, IBAN, IP, SSN, ISO_DATE, DAY_DATE, MARKED_PHONE, PHONE, ABROAD, CARD))

#: The calendar from year 1 to 9999 in three eras, each permuted in itself: the first place of each and its radices.
#: Places are days, or, for dates that only day first can be read as, days from the 13th of a month on.
ERAS = ((0, 745, 931), (693_595, 272, 272), (767_579, 640, 4507))  # from 1900-01-01 and 2102-07-25 on
LATE_ERAS = ((0, 59, 7121), (420_139, 210, 210), (464_239, 1004, 1741))  # from January 1900 and May 2099 on
#: Days from the 13th on of a month, on average over the calendar's 400 years.
LATE_DAYS = 18.436875


def keyed(key: str, kind: str, value: Column, n: int) -> Column:
    """The first n hexadecimal digits of a keyed hash."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), value), 256), 1, n)


def bound(value: Column, then) -> Column:
    """``then(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def feistel(key: str, kind: str, x: Column, a: Column | int, b: Column | int) -> Column:
    """The keyed permutation of [0, a * b): x is split into a left digit of radix a and a right one of radix b; each round
    adds a keyed hash of one to the other and swaps their roles."""
    b = F.lit(b).cast("long") if isinstance(b, int) else b
    start = bound(x.cast("long"), lambda v: F.struct(F.floor(v / b).cast("long").alias("l"), F.pmod(v, b).alias("r")))
    return bound(permuted(key, kind, start, a, b), lambda s: s["l"] * b + s["r"])


def permuted(key: str, kind: str, pair: Column, a: Column | int, b: Column | int) -> Column:
    """The pair (l, r) of digits of radices a and b after all rounds."""
    a, b = (F.lit(v).cast("long") if isinstance(v, int) else v for v in (a, b))

    def step(s: Column, i: Column) -> Column:
        tag = lambda v: F.concat_ws("|", i.cast("string"), v.cast("string"))
        number = lambda v: F.conv(keyed(key, kind, tag(v), 15), 16, 10).cast("long")
        left = F.when(i % 2 == 0, F.pmod(s["l"] + F.pmod(number(s["r"]), a), a)).otherwise(s["l"])
        right = F.when(i % 2 == 1, F.pmod(s["r"] + F.pmod(number(s["l"]), b), b)).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), pair, step)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def number(m: Column, begin: int, n: int) -> Column:
    return F.substring(m, begin, n).cast("long")


def padded(x: Column, n: Column | int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def laid_out(m: Column, digits: Column) -> Column:
    """m with its digits replaced, in order, by others."""

    def step(s: Column, i: Column) -> Column:
        c = F.substr(m, i, F.lit(1))
        is_digit = c.rlike("[0-9]")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substr(digits, s["j"], F.lit(1))).otherwise(c)).alias("out"), F.when(is_digit, s["j"] + 1).otherwise(s["j"]).alias("j"))

    return F.aggregate(F.sequence(F.lit(1), F.length(m)), F.struct(F.lit("").alias("out"), F.lit(1).alias("j")), step)["out"]


def luhn_sum(d: Column, doubled: int) -> Column:
    """Sum of digits, from the right; of those at odd or even places from there the doubles' digits."""

    def step(s: Column, i: Column) -> Column:
        v = F.substr(d, F.length(d) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == doubled, 2).otherwise(1)
        return s + v - F.when(v > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step)


def card(key: str, m: Column) -> Column:
    """First digit kept, the last recomputed; those between are permuted."""

    def new(d: Column) -> Column:
        n = F.length(d) - 2
        half = (n / 2).cast("int")
        size = lambda k: F.round(F.pow(F.lit(10.0), k)).cast("long")
        middle = feistel(key, "card", F.substr(d, F.lit(2), n).cast("long"), size(half), size(n - half))
        body = F.concat(F.substring(d, 1, 1), padded(middle, n))
        return bound(body, lambda x: laid_out(m, F.concat(x, F.pmod(10 - F.pmod(luhn_sum(x, 1), F.lit(10)), F.lit(10)).cast("string"))))

    return bound(digits_of(m), lambda d: F.when(F.length(d).between(13, 19) & (luhn_sum(d, 0) % 10 == 0), new(d)).otherwise(m))


def phone(key: str, m: Column) -> Column:
    """Area code and exchange stay in 200 to 999, where the plan has them; all other numbers are permuted among themselves:
    those with a lower area code first, then those with a lower exchange alone."""

    def new(d: Column) -> Column:
        area, exchange, line = number(d, 1, 3), number(d, 4, 3), number(d, 7, 4)
        written_as = lambda a, e, n: laid_out(m, F.concat(F.substr(digits_of(m), F.lit(1), F.length(digits_of(m)) - 10), padded(a, 3), padded(e, 3), padded(n, 4)))
        planned = bound(feistel(key, "phone", (area - 200) * 8_000_000 + (exchange - 200) * 10_000 + line, 80_000, 80_000), lambda y: written_as(
            F.floor(y / 8_000_000) + 200, F.floor(F.pmod(y, F.lit(8_000_000)) / 10_000) + 200, F.pmod(y, F.lit(10_000))))
        low = F.lit(2_000_000_000).cast("long")
        place = F.when(area < 200, d.cast("long")).otherwise(low + (area - 200) * 2_000_000 + exchange * 10_000 + line)
        other = bound(feistel(key, "unplanned phone", place, 60_000, 60_000), lambda y: F.when(y < low, written_as(
            F.floor(y / 10_000_000), F.pmod(F.floor(y / 10_000), F.lit(1000)), F.pmod(y, F.lit(10_000)))).otherwise(written_as(
            F.floor((y - low) / 2_000_000) + 200, F.pmod(F.floor((y - low) / 10_000), F.lit(200)), F.pmod(y, F.lit(10_000)))))
        return F.when((area >= 200) & (exchange >= 200), planned).otherwise(other)

    return bound(F.substring(digits_of(m), -10, 10), new)


def abroad(key: str, m: Column) -> Column:
    """The first three digits stay; the others are permuted."""

    def new(d: Column) -> Column:
        n = F.length(d) - 3
        half = (n / 2).cast("int")
        size = lambda k: F.round(F.pow(F.lit(10.0), k)).cast("long")
        return laid_out(m, F.concat(F.substring(d, 1, 3), padded(feistel(key, "abroad", F.substr(d, F.lit(4), n).cast("long"), size(half), size(n - half)), n)))

    return bound(digits_of(m), new)


def ssn(key: str, m: Column) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99 and serials 0001 to 9999 are valid."""
    area, group, serial = number(m, 1, 3), number(m, 5, 2), number(m, 8, 4)
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    x = (place * 99 + group - 1) * 9999 + serial - 1

    def new(y: Column) -> Column:
        p = F.floor(y / (99 * 9999))
        return F.concat_ws("-", padded(p + 1 + F.when(p + 1 >= 666, 1).otherwise(0), 3), padded(F.pmod(F.floor(y / 9999), F.lit(99)) + 1, 2), padded(F.pmod(y, F.lit(9999)) + 1, 4))

    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), bound(feistel(key, "ssn", x, 898 * 99, 9999), new)).otherwise(m)


def address(key: str, m: Column) -> Column:
    parts = lambda s: F.aggregate(s, F.lit(0).cast("long"), lambda a, p: a * 256 + p.cast("long"))
    octets = lambda y: F.concat_ws(".", *(F.pmod(F.floor(y / 256**k), F.lit(256)).cast("string") for k in (3, 2, 1, 0)))
    return bound(feistel(key, "ip", parts(F.split(m, r"\.")), 65_536, 65_536), octets)


def in_era(key: str, kind: str, place: Column, eras: tuple[tuple[int, int, int], ...]) -> Column:
    """The place that another one of its era becomes."""
    of = lambda k: F.when(place >= eras[2][0], eras[2][k]).when(place >= eras[1][0], eras[1][k]).otherwise(eras[0][k]).cast("long")
    return of(0) + feistel(key, kind, place - of(0), of(1), of(2))


def days_before(d: Column) -> Column:
    return F.datediff(d, F.lit("0001-01-01").cast("date")).cast("long")


def date(key: str, m: Column) -> Column:
    """A calendar date becomes another one of its era; what is none is left. Dots: day first. Slashes: month first, or day
    first where only that is a date."""
    read = lambda form: F.to_date(F.try_to_timestamp(m, F.lit(form)))
    forms = ((m.contains("-"), "yyyy-MM-dd"), (m.contains("."), "dd.MM.yyyy"), (m.contains("/"), "MM/dd/yyyy"))
    found = F.coalesce(*(F.when(has, read(form)) for has, form in forms))

    def moved(d: Column) -> Column:
        new = bound(days_before(d), lambda n: F.date_add(F.lit("0001-01-01").cast("date"), in_era(key, "date", n, ERAS).cast("int")))
        return bound(new, lambda x: F.coalesce(*(F.when(has, F.date_format(x, form)) for has, form in forms)))

    return bound(found, lambda d: F.when(d.isNotNull(), moved(d)).when(m.contains("/"), late_day(key, m)).otherwise(m))


def month_start(k: Column) -> Column:
    """The first day of the k-th month of the calendar, from 0."""
    return F.make_date((F.floor(k / 12) + 1).cast("int"), (F.pmod(k, F.lit(12)) + 1).cast("int"), F.lit(1))


def late_day(key: str, m: Column) -> Column:
    """Day and month of a date after a month's 12th: among just those dates, so that no other layout's results are met."""
    start = lambda k: days_before(month_start(k)) - 12 * k  # noqa: E731  places of earlier months

    def place(d: Column) -> Column:
        return bound(((F.year(d) - 1) * 12 + F.month(d) - 1).cast("long"), lambda k: start(k) + F.dayofmonth(d) - 13)

    def written_as(y: Column) -> Column:
        near = F.least(F.floor(y / LATE_DAYS).cast("long"), F.lit(9999 * 12 - 1).cast("long"))
        month = bound(near, lambda k: k - F.when(y < start(k), 1).otherwise(0) + F.when((k < 9999 * 12 - 1) & (y >= start(k + 1)), 1).otherwise(0))
        return bound(month, lambda k: F.date_format(F.date_add(month_start(k), (y - start(k) + 12).cast("int")), "dd/MM/yyyy"))

    date = F.to_date(F.try_to_timestamp(m, F.lit("dd/MM/yyyy")))
    return bound(date, lambda d: F.when(d.isNull(), m).otherwise(bound(in_era(key, "late day", place(d), LATE_ERAS), written_as)))


def remainder(account: Column) -> Column:
    """Of an account's letters (A is 10) and digits, as one number, by 97."""

    def step(acc: Column, i: Column) -> Column:
        c = F.substr(account, i, F.lit(1))
        return F.pmod(F.when(c.rlike("[0-9]"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55), F.lit(97))

    return F.aggregate(F.sequence(F.lit(1), F.length(account)), F.lit(0), step)


def iban(key: str, m: Column) -> Column:
    """Country, length and letters stay, the account's digits are permuted and the check digits recomputed."""

    def new(c: Column) -> Column:
        own = F.substr(c, F.lit(5), F.length(c) - 4)
        n = F.length(digits_of(own))
        half = F.floor(n / 2).cast("int")
        size = lambda k: F.round(F.pow(F.lit(10.0), k)).cast("long")
        pair = bound(digits_of(own), lambda d: F.struct(F.substr(d, F.lit(1), half).cast("long").alias("l"), F.substr(d, half + 1, n - half).cast("long").alias("r")))
        digits = bound(permuted(key, "iban", pair, size(half), size(n - half)), lambda p: F.concat(padded(p["l"], half), padded(p["r"], n - half)))
        checked = lambda x: F.concat(F.substring(c, 1, 2), padded(98 - remainder(F.concat(x, F.substring(c, 1, 2), F.lit("00"))), 2), x)
        return bound(laid_out(own, digits), lambda x: relaid(m, checked(x)))

    compact = F.regexp_replace(m, " ", "")
    valid = lambda c: (remainder(F.concat(F.substr(c, F.lit(5), F.length(c) - 4), F.substring(c, 1, 4))) == 1) & (F.length(digits_of(c)) >= 6)
    # What isn't valid may still hold a card number behind its first four characters.
    return bound(compact, lambda c: F.when(valid(c), new(c)).otherwise(F.concat(F.substring(m, 1, 4), card(key, F.substr(m, F.lit(5), F.length(m) - 4)))))


def relaid(m: Column, text: Column) -> Column:
    """``text`` with the blanks that m has, where it has them."""

    def step(s: Column, i: Column) -> Column:
        blank = F.substr(m, i, F.lit(1)) == " "
        return F.struct(F.concat(s["out"], F.when(blank, " ").otherwise(F.substr(text, s["j"], F.lit(1)))).alias("out"), F.when(blank, s["j"]).otherwise(s["j"] + 1).alias("j"))

    return F.aggregate(F.sequence(F.lit(1), F.length(m)), F.struct(F.lit("").alias("out"), F.lit(1).alias("j")), step)["out"]


def secret(key: str, m: Column) -> Column:
    """The name of an assigned secret stays; the value goes."""
    head = F.regexp_extract(m, rf"^(?:(?i:password|passwd|token|secret|api_key|apikey)\s*[=:]\s*[\"']?|(?i:bearer)\s+)?", 0)
    tail = F.regexp_extract(m, r"[\"']?$", 0)
    body = F.substr(m, F.length(head) + 1, F.length(m) - F.length(head) - F.length(tail))
    return F.concat(head, F.lit("[SECRET-"), keyed(key, "secret", body, 16), F.lit("]"), tail)


def pseudonym(key: str, m: Column) -> Column:
    """What a match of ANY becomes; itself where it isn't valid."""
    whole = lambda p: m.rlike(rf"\A(?:{p})\z")
    return (
        F.when(m.contains("@") & whole(EMAIL), F.concat(F.lit("user-"), keyed(key, "email", F.lower(m), 16), F.lit("@example.invalid")))
        .when(whole(SECRET), secret(key, m))
        .when(whole(IBAN), iban(key, m))
        .when(m.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"), address(key, m))
        .when(whole(SSN), ssn(key, m))
        .when(whole(f"{ISO_DATE}|{DAY_DATE}"), date(key, m))
        .when(whole(f"{MARKED_PHONE}|{PHONE}"), phone(key, m))
        .when(whole(ABROAD), abroad(key, m))
        .otherwise(card(key, m))
    )


def pseudonymised(docs: DataFrame, key: str, text: str = "text", replaced: str = "pii_replaced") -> DataFrame:
    """``docs`` with its text column pseudonymised, and the number of values replaced."""
    t = F.col(text)
    (looked,) = free_names(docs, "pii_looked")
    found = F.transform(F.regexp_extract_all(t, F.lit(ANY), F.lit(0)), lambda m: F.struct(m.alias("old"), pseudonym(key, m).alias("new")))
    # Bound by a column of its own, so that it is computed once.
    parts = F.when(t.rlike(HINT), F.struct(F.split(t, ANY, -1).alias("between"), found.alias("found")))
    rows = docs.select(*docs.columns, F.inline(F.array(F.struct(parts.alias(looked)))))
    between, found, seen = F.col(looked)["between"], F.col(looked)["found"], F.col(looked).isNotNull()
    joined = F.array_join(F.zip_with(between, found, lambda a, m: F.concat(a, F.coalesce(m["new"], F.lit("")))), "")
    count = F.size(F.filter(found, lambda m: m["old"] != m["new"])).cast("long")
    columns = [F.when(seen, joined).otherwise(t).alias(text) if c == text else F.col(c) for c in docs.columns]
    return rows.select(*columns, F.when(seen, count).otherwise(F.lit(0)).cast("long").alias(replaced))


def configured_key(spark: SparkSession) -> str:
    return spark.conf.get(SETTING, None) or DEMONSTRATION_KEY


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(read_spread(spark, sf_dir, "documents").select("doc_id", "text"), configured_key(spark))
