"""Scalar kit: normalised forms, shapes, keyed tokens, ids, templates, severities — as Column expressions.

Everything here is native, so it stays inside generated code. Two Arrow functions at the end cover what Spark has no
expression for: Unicode compatibility normalisation and phonetic codes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the canonical event contract.
MAX_VALUE, MAX_ATTRIBUTE, MAX_SHAPE, MAX_RUN, MAX_SEGMENT = 1024, 256, 64, 12, 64
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
#: Words that mark a service account, and words of errors in free text.
SERVICE_WORDS = ("svc", "api", "integration", "system", "bot", "daemon", "service")
ERROR_WORDS = ("error", "exception", "failed", "refused", "denied", "timeout", "unauthorized", "forbidden")
#: Forms that mark a secret (signed token, key block, cloud key id), and long runs of mixed characters.
SECRET_FORMS = (
    r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    r"-----BEGIN [A-Z ]+-----",
    r"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])",
)
SECRET_RUN, LEAST_SECRET, LEAST_BITS = r"[A-Za-z0-9+/=_-]{32,}", 20, 3.5
#: Forms of personal data; what they find is checked further.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}\b"
ACCOUNT = r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){2,8}(?![A-Z0-9])"
PHONE_ABROAD = r"(?<![0-9+])\+[1-9][0-9]{0,2}(?:[ -]?\(?[0-9]{1,4}\)?){2,5}(?![0-9])"
PHONE_NATIONAL = r"(?:\([0-9]{3}\)\s?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}"
#: Level words and syslog numbers, and the severities of each four OpenTelemetry numbers.
LEVELS = {
    "trace": "trace", "trc": "trace", "finest": "trace", "finer": "trace", "verbose": "trace",
    "debug": "debug", "dbg": "debug", "fine": "debug", "d": "debug",
    "info": "info", "inf": "info", "information": "info", "informational": "info", "notice": "info", "i": "info",
    "warn": "warn", "warning": "warn", "wrn": "warn", "w": "warn",
    "error": "error", "err": "error", "severe": "error", "e": "error",
    "fatal": "fatal", "critical": "fatal", "crit": "fatal", "emerg": "fatal", "emergency": "fatal", "alert": "fatal",
    "panic": "fatal", "f": "fatal",
    "0": "fatal", "1": "fatal", "2": "fatal", "3": "error", "4": "warn", "5": "info", "6": "info", "7": "debug",
}
NUMBERED_SEVERITIES = ("trace", "debug", "info", "warn", "error", "fatal")
MAX_LEVEL = 16


def raw(c: Column) -> Column:
    """Trimmed of white space and cut."""
    return F.substring(F.regexp_replace(c, r"^\s+|\s+$", ""), 1, MAX_VALUE)


def norm(c: Column) -> Column:
    return F.lower(raw(c))


def alnum(c: Column) -> Column:
    return F.regexp_replace(norm(c), r"[^\p{L}\p{N}]", "")


def digit_runs(c: Column) -> Column:
    """The first three runs of four ASCII digits or more, without leading zeros; empty ones stay in place."""
    return F.transform(F.slice(F.regexp_extract_all(c, F.lit(r"[0-9]{4,}"), F.lit(0)), 1, 3), lambda x: F.ltrim(x, F.lit("0")))


def shape(c: Column) -> Column:
    """Digits as 9, letters as A, long runs shortened."""
    marked = F.regexp_replace(F.regexp_replace(c, r"\p{Nd}", "9"), r"\p{L}", "A")
    return F.substring(F.regexp_replace(marked, r"(?s)((.)\2{11})\2+", "$1+"), 1, MAX_SHAPE)


def shape_domain(c: Column) -> Column:
    """How many values a shape can hold: ten for each digit and 26 for each letter, as a double."""
    return F.pow(F.lit(10.0), F.regexp_count(c, F.lit("9"))) * F.pow(F.lit(26.0), F.regexp_count(c, F.lit("A")))


def amount_minor_units(c: Column) -> Column:
    """Amounts in text as whole cents, half up; null where the text is no amount.

    With both separators present the later one is decimal; one that repeats, or a comma before exactly three digits,
    groups thousands. Parentheses and a minus on either side make it negative.
    """
    comma_decimal = lambda b: b.rlike(r"^[0-9]{1,3}(\.[0-9]{3})*,[0-9]{1,4}$") & ~b.rlike(r"^[0-9]{1,3}(,[0-9]{3})+$")
    plain = lambda b: F.when(comma_decimal(b), F.replace(F.replace(b, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(
        F.replace(b, F.lit(","), F.lit(""))
    )
    number = lambda p: F.when(p.rlike(r"^[0-9]{1,16}(\.[0-9]+)?$"), p).try_cast("decimal(38,10)")
    cents = lambda t: F.round(let(let(F.regexp_replace(t, r"[()+-]", ""), plain), number) * 100, 0).cast("bigint")
    signed = lambda t: let(cents(t), lambda n: F.when(t.rlike(r"^\(.*\)$|^-|-$"), -n).otherwise(n))
    return let(F.regexp_replace(c, r"[\s$€£¥]|USD|EUR|GBP", ""), signed)


def date_form(c: Column) -> Column:
    """Dates in text as ISO text; day first only where the first part cannot be a month; years 1900 to 2199."""
    d = F.coalesce(
        F.try_to_date(F.regexp_extract(c, r"^\s*(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd"),
        F.try_to_date(F.when(c.rlike(r"^\d{8}$"), c), "yyyyMMdd"),
        F.try_to_date(F.when(c.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), c), "M/d/yyyy"),
        F.try_to_date(F.when(c.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), c), "d/M/yyyy"),
        F.try_to_date(F.when(c.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), c), "d.M.yyyy"),
        F.try_to_date(F.when(c.rlike(r"^\d{1,2} [A-Z][a-z]{2} \d{4}$"), c), "d MMM yyyy"),
    )
    return F.when(F.year(d).between(1900, 2199), F.date_format(d, "yyyy-MM-dd"))


def token_domain(form: Column) -> Column:
    return (
        F.when(form == "date", "date")
        .when(form == "amount", "amt")
        .when(form.startswith("phonetic"), "ph")
        .otherwise("id")
    )


def hmac_sha256_hex(message: Column, key: bytes) -> Column:
    """HMAC by its definition, from two native digests. The padded key becomes part of the plan."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in block).hex())) for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(inner, message.cast("binary")), 256)
    return F.sha2(F.concat(outer, F.unhex(first)), 256)


def token(domain: Column, value: Column, key: bytes, version: int = 1) -> Column:
    """t<version>.<22 characters>: the keyed form in which identifiers travel."""
    digest = F.unhex(hmac_sha256_hex(F.concat(domain, F.lit("\0"), value), key))
    return F.concat(F.lit(f"t{version}."), F.substring(F.translate(F.base64(digest), "+/", "-_"), 1, 22))


def _base32(number: Column, digits: int) -> Column:
    return F.concat(
        *[
            F.substring(F.lit(CROCKFORD), (F.shiftright(number, 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
            for i in reversed(range(digits))
        ]
    )


def event_ulid(ms: Column, source: Column, locator: Column) -> Column:
    """A sortable id that depends only on time, source and place, so that re-reading gives the same id."""
    digest = F.sha2(F.concat(source, F.lit("\0"), locator).cast("binary"), 256)
    part = lambda at: F.conv(F.substring(digest, at, 10), 16, 10).cast("bigint")
    return F.concat(_base32(ms, 10), _base32(part(1), 8), _base32(part(11), 8))


def ulid_ms(c: Column) -> Column:
    digits = F.split(F.substring(c, 1, 10), "")
    return F.aggregate(digits, F.lit(0).cast("bigint"), lambda acc, x: acc * 32 + F.instr(F.lit(CROCKFORD), x) - 1)


def template_id(system: Column, text: Column) -> Column:
    return F.concat(F.lit("tpl_"), F.substring(F.sha2(F.concat(system, F.lit("\0"), text), 256), 1, 12))


def generalized_name(c: Column) -> Column:
    """File names with digit runs as *."""
    return F.regexp_replace(c, "[0-9]+", "*")


def route(c: Column) -> Column:
    """Path of a URL with ids as *; query and fragment go."""
    path = F.regexp_replace(F.regexp_replace(c, r"^[a-z]+://[^/?#]*", ""), r"[?#].*$", "")
    segments = F.transform(
        F.split(path, "/"),
        lambda s: F.when(s.rlike(r"^([0-9a-fA-F]{16,}|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$"), F.lit("*")).otherwise(
            F.regexp_replace(s, "[0-9]+", "*")
        ),
    )
    joined = F.array_join(segments, "/")
    return F.when(joined == "", "-").otherwise(joined)


def safe_segment(c: Column) -> Column:
    """A field name that looks like a value becomes *."""
    return F.when((F.length(c) > MAX_SEGMENT) | (F.instr(F.substring(c, 2, 1024), "@") > 0) | c.rlike("[0-9]{3}"), "*").otherwise(c)


def key_signature(keys: Column) -> Column:
    return F.concat(F.lit("keys:"), F.array_join(F.slice(F.array_sort(keys), 1, 32), ","))


def level_severity(c: Column) -> Column:
    """A level word, also in brackets or before a colon, or a syslog number."""
    bare = F.regexp_replace(F.trim(c), r"^[\[\]()<>]+|[\[\]()<>]+$", "")
    level = F.lower(F.trim(F.rtrim(bare, F.lit(":"))))
    table = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    return F.when(F.length(F.trim(c)) <= MAX_LEVEL, F.try_element_at(table, level))


def numbered_severity(c: Column) -> Column:
    """The severity of an OpenTelemetry number from 1 to 24."""
    number = F.when(F.trim(c).rlike("^[0-9]{1,2}$"), F.trim(c).cast("int"))
    return F.when(number >= 1, F.get(F.array(*map(F.lit, NUMBERED_SEVERITIES)), F.floor((number - 1) / 4).cast("int")))


def status_severity(c: Column) -> Column:
    return F.when(c.between(500, 599), "error").when(c.between(400, 499), "warn").when(c.between(100, 399), "info")


def lexicon_severity(c: Column) -> Column:
    return F.when(c.rlike(r"(?i)\b(" + "|".join(ERROR_WORDS) + r")\b"), "error")


def actor_kind(c: Column) -> Column:
    name = F.lower(F.trim(c))
    parts = F.split(name, r"[_\-.:@/ ]")
    service = (
        name.rlike(r"^svc[_\-.]")
        | F.arrays_overlap(parts, F.array(*map(F.lit, SERVICE_WORDS)))
        | name.rlike("integration|daemon|system")
    )
    return F.when(c.isNull() | (name == ""), "unknown").when(service, "service").otherwise("human")


def attribute(c: Column) -> Column:
    return F.substring(F.trim(c), 1, MAX_ATTRIBUTE)


def timestamp(c: Column) -> Column:
    """Text in ISO, epoch seconds or milliseconds, access-log, slash or RFC 2822 style as a UTC timestamp."""
    numbered = lambda n: F.when(n >= 1e11, F.timestamp_millis(n.cast("bigint"))).when(n.between(0, 4.2e9), F.timestamp_micros((n * 1_000_000).cast("bigint")))
    found = F.coalesce(
        F.when(c.rlike(r"^[0-9]{9,13}(\.[0-9]+)?$"), let(c.try_cast("double"), numbered)),
        F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2})?"), c).try_cast("timestamp"),
        F.try_to_timestamp(F.regexp_extract(c, r"^\[?(\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4})\]?$", 1), F.lit("dd/MMM/yyyy:HH:mm:ss Z")),
        F.try_to_timestamp(F.regexp_extract(c, r"^(\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2})$", 1), F.lit("MM/dd/yyyy HH:mm:ss")),
        F.try_to_timestamp(F.regexp_extract(c, r"^(?:[A-Z][a-z]{2}, )?(\d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4})$", 1), F.lit("dd MMM yyyy HH:mm:ss Z")),
    )
    return let(found, lambda f: F.when(F.year(f).between(1970, 2100), F.date_trunc("MILLISECOND", f)))


def syslog_timestamp(c: Column, reference: Column) -> Column:
    """`Jan  2 03:04:05` without a year: the reference's year, or the one before if that lies over a day ahead."""
    stamp = F.regexp_replace(F.regexp_extract(c, r"^([A-Z][a-z]{2} [ 0-3]?\d \d{2}:\d{2}:\d{2})", 1), r" +", " ")
    of = lambda year: F.try_to_timestamp(F.concat(year.cast("string"), F.lit(" "), stamp), F.lit("yyyy MMM d HH:mm:ss"))
    this = of(F.year(reference))
    return F.when(this > reference + F.expr("interval 1 day"), of(F.year(reference) - 1)).otherwise(this)


def temporal_kind(c: Column) -> Column:
    """Whether a value reads as a date or as a date with time, by conservative patterns."""
    moment = c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?|^\d{2}/[A-Z][a-z]{2}/\d{4}:|^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}")
    return F.when(moment & timestamp(c).isNotNull(), "datetime").when(date_form(c).isNotNull(), "date")


def luhn(c: Column) -> Column:
    """Whether the digits of the text pass the Luhn check."""
    digits = F.transform(F.split(F.reverse(F.regexp_replace(c, "[^0-9]", "")), ""), lambda x: x.try_cast("int"))
    doubled = F.transform(digits, lambda x, i: F.when(i % 2 == 1, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x))
    return F.aggregate(doubled, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0))) % 10 == 0


def card_numbers(c: Column) -> Column:
    """Runs of digits, single spaces and dashes in which some groups in a row make a card number.

    A card has 13 to 19 digits, not all equal, of which the first is 1, 3, 4, 5 or 6, and passes the Luhn check.
    """
    runs = F.filter(F.regexp_extract_all(c, F.lit("-?[0-9](?:[ -]?[0-9])+-?"), F.lit(0)), lambda r: ~r.rlike("^-|-$"))

    def has_card(run: Column) -> Column:
        groups = F.split(run, "[ -]")
        size = F.size(groups)
        joined = F.transform(
            F.sequence(F.lit(1), size),
            lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(19), size - i + 1)), lambda k: F.array_join(F.slice(groups, i, k), "")),
        )
        return F.exists(F.flatten(joined), lambda d: d.rlike("^[13456][0-9]{12,18}$") & ~d.rlike(r"^(.)\1+$") & luhn(d))

    return F.filter(runs, has_card)


def security_numbers(c: Column) -> Column:
    """Social security numbers that are given out: no area 000, 666 or from 900 on, no group 00, no serial 0000."""
    runs = F.filter(F.regexp_extract_all(c, F.lit("[0-9-]+"), F.lit(0)), lambda r: r.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"))
    given = lambda r: ~F.substring(r, 1, 3).isin("000", "666") & (F.substring(r, 1, 1) != "9") & (F.substring(r, 5, 2) != "00") & (F.substring(r, 8, 4) != "0000")
    return F.filter(runs, given)


def national_phones(c: Column) -> Column:
    """Ten digits in three groups, the first perhaps in parentheses, with no digit or dash before or after."""
    found = F.regexp_extract_all(c, F.lit(f"[0-9-]?{PHONE_NATIONAL}[0-9-]?"), F.lit(0))
    return F.filter(found, lambda x: x.rlike(f"^{PHONE_NATIONAL}$"))


def iban(c: Column) -> Column:
    """Whether the text is an account number that passes mod 97."""
    text = F.upper(F.regexp_replace(c, r"\s", ""))
    turned = F.concat(F.substring(text, 5, 64), F.substring(text, 1, 4))
    values = F.transform(F.split(turned, ""), lambda x: F.conv(x, 36, 10).cast("int"))
    rest = F.aggregate(values, F.lit(0), lambda acc, x: (acc * F.when(x > 9, 100).otherwise(10) + x) % 97)
    return text.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (F.coalesce(rest, F.lit(0)) == 1)


def entropy(c: Column) -> Column:
    """Bits a character."""
    total = F.length(c)
    share = lambda x: (total - F.length(F.replace(c, x, F.lit("")))) / total
    return F.aggregate(F.array_distinct(F.split(c, "")), F.lit(0.0), lambda acc, x: acc - F.when(x != "", share(x) * F.log2(share(x))).otherwise(0.0))


def looks_like_secret(c: Column) -> Column:
    """A form that marks a secret, or any long run with both cases and digits and much information a character."""
    mixed = lambda run: run.rlike("[a-z]") & run.rlike("[A-Z]") & run.rlike("[0-9]") & (entropy(run) >= LEAST_BITS)
    runs = F.regexp_extract_all(c, F.lit(SECRET_RUN), F.lit(0))
    return (F.length(c) >= LEAST_SECRET) & (c.rlike("|".join(SECRET_FORMS)) | F.exists(runs, mixed))


def csv_cell(c: Column) -> Column:
    """Cells that a spreadsheet would take for a formula get a quote in front."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _with_matches(text: Column, pattern: str, change) -> Column:
    """The text with every match of the pattern changed."""

    def changed(t: Column) -> Column:
        between, found = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        return F.array_join(F.zip_with(between, F.transform(found, change), lambda b, m: F.concat(b, F.coalesce(m, F.lit("")))), "")

    return let(text, lambda t: F.when(t.rlike(pattern), changed(t)).otherwise(t))


def _hide_cards(text: Column) -> Column:
    """The first card number of each run of digits masked; see card_numbers for what a card is.

    Single separators within a run stand as characters that no text carries, so that a run is one class of characters
    and long ones are matched without recursion.
    """
    joined = F.regexp_replace(F.regexp_replace(text, "(?<=[0-9]) (?=[0-9])", "\uFDD0"), "(?<=[0-9])-(?=[0-9])", "\uFDD1")

    def first_card(groups: Column) -> Column:
        """Its first group (from 1) and its number of groups."""
        size = F.size(groups)
        number = lambda i, k: F.array_join(F.slice(groups, i, k), "")
        card = lambda d: d.rlike("^[13456][0-9]{12,18}$") & ~d.rlike(r"^(.)\1+$") & luhn(d)
        widths = lambda i: F.sequence(F.lit(1), F.least(F.lit(19), size - i + 1))
        least = lambda i: F.get(F.filter(widths(i), lambda k: let(number(i, k), card)), 0)
        found = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(i.alias("i"), least(i).alias("k")))
        return F.get(F.filter(found, lambda p: p["k"].isNotNull()), 0)

    def hidden(run: Column, groups: Column, hit: Column) -> Column:
        ahead = F.length(F.array_join(F.slice(groups, 1, hit["i"] - 1), " ")) + F.when(hit["i"] > 1, 1).otherwise(0)
        width = F.length(F.array_join(F.slice(groups, hit["i"], hit["k"]), " "))
        return F.concat(F.substring(run, F.lit(1), ahead), F.lit("<CREDIT_CARD>"), F.substring(run, ahead + width + 1, F.length(run)))

    def change(run: Column) -> Column:
        masked = let(
            F.split(run, "[\uFDD0\uFDD1]"),
            lambda groups: let(first_card(groups), lambda hit: F.when(hit.isNotNull(), hidden(run, groups, hit)).otherwise(run)),
        )
        return F.when((F.length(run) >= 13) & ~run.rlike("^-|-$"), masked).otherwise(run)

    return F.translate(_with_matches(joined, "-?[0-9][0-9\uFDD0\uFDD1]*-?", change), "\uFDD0\uFDD1", " -")


def hide(text: Column) -> Column:
    """Text with e-mail addresses, account numbers, phone numbers, cards and social security numbers masked.

    Kinds go in this order, and what one has masked the next ones do not see: of spans that overlap, that of the earlier
    kind stays. Account and card numbers must pass their checksums; an international number has 8 digits or more.
    """
    where = lambda test, kind: lambda m: F.when(test(m), F.lit(f"<{kind}>")).otherwise(m)
    digits = lambda m: F.length(F.regexp_replace(m, "[^0-9]", ""))
    out = F.regexp_replace(text, EMAIL, "<EMAIL_ADDRESS>")
    out = _with_matches(out, ACCOUNT, where(iban, "IBAN_CODE"))
    out = _with_matches(out, PHONE_ABROAD, where(lambda m: digits(m) >= 8, "PHONE_NUMBER"))
    out = _hide_cards(out)
    out = _with_matches(out, "[0-9-]+", where(lambda m: F.size(security_numbers(m)) > 0, "US_SSN"))
    return _with_matches(out, f"[0-9-]?{PHONE_NATIONAL}[0-9-]?", where(lambda m: F.size(national_phones(m)) > 0, "PHONE_NUMBER"))


def mask_message(c: Column) -> Column:
    """Words with a digit or an @ as <*>: the first grouping of log messages."""
    words = F.slice(F.filter(F.split(c, r"\s+"), lambda t: t != ""), 1, 512)
    return F.array_join(F.transform(words, lambda t: F.when(t.rlike("[0-9@]"), "<*>").otherwise(t)), " ")


@F.pandas_udf(T.StringType())
def nfkc(values):
    """Compatibility normalisation; ask for it only where text is not ASCII."""
    import unicodedata

    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def raw_unicode(c: Column) -> Column:
    return raw(F.when(c.rlike(r"[^\x00-\x7F]"), nfkc(c)).otherwise(c))


def phonetic(c: Column) -> Column:
    """Soundex of each name part, eight at most: the phonetic form that Spark has natively."""
    parts = F.slice(F.filter(F.split(alnum_words(c), " "), lambda x: x != ""), 1, 8)
    return F.transform(parts, lambda x: F.soundex(x))


def alnum_words(c: Column) -> Column:
    return F.trim(F.regexp_replace(norm(c), r"[^\p{L}\p{N}]+", " "))
