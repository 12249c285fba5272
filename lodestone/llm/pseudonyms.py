"""Format-preserving Feistel pseudonyms for personal numbers and dates, in DataFrame functions only.

Candidates are found by one regular expression a text, validated (Luhn for cards, octets for IP
addresses, the calendar for dates, area rules for social security and North American phone numbers),
and keyed-permuted inside their own format by an eight-round Feistel network over mixed radices: the two
halves of a value's digits take turns, each digit having its part of a keyed SHA-512 of the other half added modulo
its radix. Separators have no part in it and are put back afterwards, so a card or phone is linked over its notations.
The mapping is one to one for a key and kind, so equal values stay linked across documents,
and `restore` inverts it. Cards keep the first digit and get their check digit anew; dates move inside the
146,097 days 1800-01-01 to 2199-12-31; phones keep the country code; of e-mail addresses the local part
is permuted letter for letter and digit for digit, and the domain stays.

Cards are validated before the expression is made, so digits beside a card don't hide it: the usual groupings
at every start of a group, any other grouping once, as far as it reaches. +1 takes exactly ten more digits.

Values that fail validation stay as they are. Null and empty texts stay, with 0 values; an empty table gives an
empty table. Texts without a digit and an at sign skip the pattern. Extra columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tables import fresh

ROUNDS = 8
#: How many cells one SHA-512 serves.
CELLS = 16
#: Fixed formats, tried in this order.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])[2-6](?:[ -]?[0-9]){12,18}(?![0-9])"
#: Groupings that cards are written in, tried in this order at every start of a group: one run; 4-4-4-4; 4-6-5 and 4-6-4; 4-4-4-4-3.
CARD_FORMS = (r"[2-6][0-9]{12,18}", r"[2-6][0-9]{3}(?:[ -]?[0-9]{4}){3}", r"[2-6][0-9]{3}[ -]?[0-9]{6}[ -]?[0-9]{5}", r"[2-6][0-9]{3}[ -]?[0-9]{6}[ -]?[0-9]{4}", r"[2-6][0-9]{3}(?:[ -]?[0-9]{4}){3}[ -]?[0-9]{3}")
PHONE = r"\+[0-9](?:[ .()-]{0,2}[0-9]){7,14}(?![0-9])|(?<![0-9(])\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
#: North American numbers with +1 (exactly ten more digits) and without.
PLUS_ONE = r"\+1[ .()-]{0,2}[2-9](?:[ .()-]{0,2}[0-9]){2}[ .()-]{0,2}[2-9](?:[ .()-]{0,2}[0-9]){6}(?![0-9])"
PLAIN = r"(?<![0-9(])\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])"


def _pattern(cards: Column | str) -> Column:
    """The pattern of all candidates, `cards` being alternatives for the cards of a text; "" where it has none.

    A number with + ends before a separator that another value follows, if it has eight digits by then.
    """
    none = cards == F.lit("")
    other = F.concat(F.lit("|".join([IP, DATE, SSN, PLAIN])), F.when(none, "").otherwise(F.concat(F.lit("|"), cards)))
    more = r"[ .()-]{0,2}[0-9]){7,14}(?![0-9])"
    foreign = F.concat(F.lit(r"\+[0-9](?:(?![ .()-]{1,2}(?:"), other, F.lit("))" + more + r"|\+[0-9](?:" + more))
    before = F.concat(F.lit("|".join([EMAIL, IP, DATE, SSN]) + "|"), F.when(none, "").otherwise(F.concat(cards, F.lit("|"))))
    return F.concat(before, F.lit(PLUS_ONE + "|"), foreign, F.lit("|" + PLAIN))


def _alternatives(cards: Column) -> Column:
    return F.when(F.size(cards) > 0, F.concat(F.lit("(?<![0-9])(?:"), F.array_join(cards, "|"), F.lit(")(?![0-9])"))).otherwise("")


def _luhn(m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    return F.pmod(_luhn_sum(digits.substr(F.lit(1), F.length(digits) - 1)) + F.substring(digits, -1, 1).cast("int"), F.lit(10)) == 0


def _feistel(cells: Column, key: str, kind: str, sign: int) -> Column:
    """cells: array<struct<v, r>>, v in [0, r) -> array of every v permuted; sign -1 undoes it.

    A round has one keyed SHA-512 of the other half for every CELLS cells; each cell adds its own eight hex digits of it.
    """
    half = F.floor(F.size(cells) / 2).cast("int")
    order = range(ROUNDS) if sign > 0 else range(ROUNDS - 1, -1, -1)
    state = F.transform(cells, lambda c: F.struct(c.v.cast("bigint").alias("v"), c.r.cast("bigint").alias("r"), half.alias("h")))

    def one(now: Column, r: Column) -> Column:
        left = r % 2 == 0
        h = F.get(now, F.lit(0)).h
        mine = F.when(left, h).otherwise(F.size(now) - h)
        rest = F.when(left, F.slice(now, h + 1, F.size(now) - h)).otherwise(F.slice(now, F.lit(1), h))
        told = F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), F.concat_ws(",", F.transform(rest, lambda c: c.v.cast("string"))))
        blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((mine - 1) / CELLS).cast("int")))
        digest = F.concat_ws("", F.transform(F.array(told), lambda t: F.concat_ws("", F.transform(blocks, lambda j: F.sha2(F.concat_ws("|", t, j.cast("string")), 512)))))

        def cell(text: Column, c: Column, i: Column) -> Column:
            at = F.when(left, i).otherwise(i - c.h)
            added = F.conv(text.substr(8 * at + 1, F.lit(8)), 16, 10).cast("bigint")
            return F.struct(F.when(left == (i < c.h), F.pmod(c.v + F.lit(sign) * added, c.r)).otherwise(c.v).alias("v"), c.r.alias("r"), c.h.alias("h"))

        # the digest rides in a one-element array, so it is made once a round
        return F.flatten(F.transform(F.array(digest), lambda text: F.transform(now, lambda c, i: cell(text, c, i))))

    return F.transform(F.aggregate(F.lit(list(order)), state, one), lambda c: c.v)


def _cells(values: list[Column], radices: list[int]) -> Column:
    return F.array(*[F.struct(v.cast("bigint").alias("v"), F.lit(r).cast("bigint").alias("r")) for v, r in zip(values, radices, strict=True)])


def _digits(m: Column) -> Column:
    """The digits of m as an array of strings; separators have no part in a value."""
    return F.regexp_extract_all(m, F.lit("([0-9])"), 1)


def _written(m: Column, places: str, new: Column) -> Column:
    """m with each character that `places` matches replaced by the next of `new`."""
    return F.array_join(F.zip_with(F.split(m, places, -1), new, lambda kept, c: F.concat(kept, F.coalesce(c, F.lit("")))), "")


def _tens(digits: Column) -> Column:
    return F.transform(digits, lambda d: F.struct(d.cast("bigint").alias("v"), F.lit(10).cast("bigint").alias("r")))


def _texts(values: Column) -> Column:
    return F.transform(values, lambda v: v.cast("string"))


def _luhn_sum(digits: Column) -> Column:
    """Sum with every second digit doubled, the last digit of `digits` being one that is doubled."""
    n = F.length(digits)
    return F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda s, i: s + F.when((n - i) % 2 == 0, F.get(F.lit([0, 2, 4, 6, 8, 1, 3, 5, 7, 9]), digits.substr(i, F.lit(1)).cast("int"))).otherwise(digits.substr(i, F.lit(1)).cast("int")),
    )


def _card(m: Column, key: str, sign: int) -> tuple[Column, Column]:
    digits = _digits(m)
    n = F.size(digits)
    middle = _texts(_feistel(_tens(F.slice(digits, F.lit(2), n - 2)), key, "card", sign))
    lead = F.concat(F.slice(digits, 1, 1), middle)
    check = F.pmod(-_luhn_sum(F.array_join(lead, "")), F.lit(10))
    return _luhn(m), _written(m, "[0-9]", F.concat(lead, F.array(check.cast("string"))))


def _ip(m: Column, key: str, sign: int) -> tuple[Column, Column]:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    valid = F.forall(octets, lambda x: x < 256)
    new = _feistel(_cells([F.get(octets, F.lit(i)) for i in range(4)], [256] * 4), key, "ip", sign)
    return valid, F.array_join(_texts(new), ".")


def _ssn(m: Column, key: str, sign: int) -> tuple[Column, Column]:
    part = F.transform(F.split(m, "-"), lambda x: x.cast("int"))
    a, g, s = (F.get(part, F.lit(i)) for i in range(3))
    valid = (a > 0) & (a != 666) & (a < 900) & (g > 0) & (s > 0)
    new = _feistel(_cells([F.when(a < 666, a - 1).otherwise(a - 2), g - 1, s - 1], [898, 99, 9999]), key, "ssn", sign)
    area = F.get(new, F.lit(0))
    parts = (F.when(area < 665, area + 1).otherwise(area + 2), F.get(new, F.lit(1)) + 1, F.get(new, F.lit(2)) + 1)
    return valid, F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in zip(parts, (3, 2, 4), strict=True)])


def _date(m: Column, key: str, sign: int) -> tuple[Column, Column]:
    """Years first, or days first; a slashed date whose days-first reading is no date is read months first."""
    tried = [F.try_to_timestamp(m, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy")]
    day = F.datediff(F.coalesce(*tried), F.lit("1800-01-01").cast("date"))
    valid = F.coalesce((day >= 0) & (day < 146_097), F.lit(False))
    safe = F.when(valid, day).otherwise(0)
    new = _feistel(_cells([F.floor(safe / 773), F.pmod(safe, F.lit(773))], [189, 773]), key, "date", sign)
    to = F.date_add(F.lit("1800-01-01").cast("date"), (F.get(new, F.lit(0)) * 773 + F.get(new, F.lit(1))).cast("int"))
    out = (
        F.when(F.substring(m, 5, 1) == "-", F.date_format(to, "yyyy-MM-dd"))
        .when(F.substring(m, 3, 1) == ".", F.date_format(to, "dd.MM.yyyy"))
        .when(tried[1].isNotNull(), F.date_format(to, "dd/MM/yyyy"))
        .otherwise(F.date_format(to, "MM/dd/yyyy"))
    )
    return valid, out


def _phone(m: Column, key: str, sign: int) -> tuple[Column, Column]:
    """Numbers with +1 or without + are North American: ten digits, area and exchange beginning with 2 to 9."""
    digits = _digits(m)
    plus = m.startswith("+")
    american = F.when(plus, (F.size(digits) == 11) & (F.get(digits, F.lit(0)) == "1")).otherwise(True)
    kept = F.when(american, F.when(plus, 1).otherwise(0)).otherwise(2)
    rest = F.slice(digits, kept + 1, F.size(digits) - kept)
    valid = ~american | F.array_join(rest, "").rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$")

    def cell(d: Column, i: Column) -> Column:
        least = F.when(american & valid & i.isin(0, 3), 2).otherwise(0)
        return F.struct((d.cast("bigint") - least).alias("v"), (F.lit(10) - least).cast("bigint").alias("r"))

    new = F.transform(_feistel(F.transform(rest, cell), key, "phone", sign), lambda v, i: (v + F.when(american & valid & i.isin(0, 3), 2).otherwise(0)).cast("string"))
    return valid, _written(m, "[0-9]", F.concat(F.slice(digits, F.lit(1), kept), new))


def _email(m: Column, key: str, sign: int) -> tuple[Column, Column]:
    """Letters become letters of their case and digits digits; case has no part in the value."""
    local = F.substring_index(m, "@", 1)
    chars = F.regexp_extract_all(local, F.lit("([A-Za-z0-9])"), 1)
    least = lambda c: F.when(c <= "9", 48).when(c <= "Z", 65).otherwise(97)
    cells = F.transform(chars, lambda c: F.struct((F.ascii(c) - least(c)).cast("bigint").alias("v"), F.when(c <= "9", 10).otherwise(26).cast("bigint").alias("r")))
    new = F.zip_with(chars, _feistel(cells, key, "email", sign), lambda c, v: F.chr(v + least(c)))
    return F.lit(True), F.concat(_written(local, "[A-Za-z0-9]", new), m.substr(F.length(local) + 1, F.length(m)))


def _whole(pattern: str) -> str:
    import re

    return "^(?:" + re.sub(r"\(\?<?![^)]*\)", "", pattern) + ")$"


def _mapped(m: Column, key: str, sign: int) -> Column:
    """(kind, new) for one match; kind null and the match itself where validation fails."""
    out = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("new"))
    for kind, pattern, make in reversed([("email", EMAIL, _email), ("ip", IP, _ip), ("date", DATE, _date), ("ssn", SSN, _ssn), ("card", CARD, _card), ("phone", PHONE, _phone)]):
        valid, new = make(m, key, sign)
        out = F.when(m.rlike(_whole(pattern)) & valid, F.struct(F.lit(kind).alias("kind"), new.alias("new"))).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, key: str, *, text_col: str = "text", kinds_col: str = "pii_kinds", restore: bool = False) -> DataFrame:
    """docs with its text's values permuted under the key, and kinds_col (an input column of that name is replaced):
    the kind of each value replaced, in order.

    restore undoes an earlier call with the same key. The key stands in Spark's plans: let spark.redaction.string.regex
    match it where plans are logged.
    """
    cards, pattern, found, new = fresh(docs, "cards", "pattern", "found", "new")
    text, none = F.col(f"`{text_col}`"), F.array().cast("array<string>")
    may = text.rlike("[0-9@]")
    runs = [F.regexp_extract_all(text, F.lit(f"(?<![0-9])(?=({form})(?![0-9]))"), 1) for form in CARD_FORMS]
    held = docs.withColumn(cards, F.when(text.rlike(r"(?<![0-9])[2-6](?:[ -]?[0-9]){12}"), F.array_distinct(F.filter(F.concat(*runs), _luhn))))
    # other groupings get one try, in what the values of a fixed form leave
    left = F.regexp_replace(text, _pattern(_alternatives(F.col(cards))), F.lit("#"))
    odd = F.filter(F.regexp_extract_all(left, F.lit(f"({CARD})"), 1), _luhn)
    held = held.withColumn(cards, F.when(F.col(cards).isNotNull(), F.array_distinct(F.concat(F.col(cards), odd))).otherwise(none))
    held = held.withColumn(pattern, F.when(F.size(cards) > 0, _pattern(_alternatives(F.col(cards)))).otherwise(_pattern(F.lit("")))).drop(cards)
    matches = F.regexp_extract_all(text, F.concat(F.lit("("), F.col(pattern), F.lit(")")), 1)
    held = held.withColumn(found, F.when(may, matches).otherwise(none))
    some = F.size(found) > 0
    mapped = F.transform(found, lambda m: _mapped(m, key, -1 if restore else 1))
    held = held.withColumn(new, F.when(some, mapped).otherwise(F.array().cast("array<struct<kind:string,new:string>>")))
    rest = F.split(text, F.col(pattern), -1)
    joined = F.array_join(F.zip_with(rest, F.transform(new, lambda x: x.new), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    kinds = F.filter(F.transform(new, lambda x: x.kind), lambda k: k.isNotNull())
    return held.withColumns({text_col: F.when(some, joined).otherwise(text), kinds_col: kinds}).drop(pattern, found, new)
