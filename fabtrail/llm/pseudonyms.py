"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions only.

Numbers and dates found in a text are checked (Luhn, mod 97, octets, calendar) and replaced by the image of a
keyed permutation of their own format: a card number becomes another valid card number, a date another
date. The permutation depends on the key and the value alone, so equal values stay equal across documents, in whatever
punctuation they are written, and different values stay different.

A text is split at its matches; the matches are mapped in place and put back between the pieces. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8

# what is looked for; in a text the first that matches at a place wins
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"
ISO_DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
DAY_FIRST = r"(?<![0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9]|\.[0-9])"
SLASHED = r"(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
PHONE = (
    r"(?<![A-Za-z0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9+])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9+.-])[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}(?![A-Za-z0-9])"
)
SSN = r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"
CARD = r"(?<![A-Za-z0-9])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])"

PATTERN = "|".join([EMAIL, IBAN, ISO_DATE, DAY_FIRST, SLASHED, IPV4, PHONE, SSN, CARD])


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 512)


def _number(key: str, modulus: int, *parts: Column) -> Column:
    """A number 0 … modulus-1 that depends on the key and the parts; 15 hex digits keep it almost even."""
    return F.pmod(F.conv(F.substring(_digest(key, *parts), 1, 15), 16, 10).cast("bigint"), F.lit(modulus))


def _network(start: Column, step, inverse: bool) -> Column:
    """Run ``step(left, right, round)`` → new right, swapping sides after each round."""
    if inverse:
        turn = lambda a, i: F.struct(step(a["r"], a["l"], i).alias("l"), a["l"].alias("r"))
        rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1))
    else:
        turn = lambda a, i: F.struct(a["r"].alias("l"), step(a["l"], a["r"], i).alias("r"))
        rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, start, turn)


def permute_characters(value: Column, key: str, inverse: bool = False) -> Column:
    """A Feistel network over a string: digits stay digits, small letters small, capitals capital.

    The two halves take turns: each character of one is moved within its class by an amount that depends on the key, the round and
    the other half. All else stays as it is. Moving is undone by moving back, so this permutes the strings of one format.
    """
    sign = -1 if inverse else 1

    def moved(c: Column, amount: Column) -> Column:
        code = F.ascii(c)
        shift = lambda low, size: F.char(F.pmod(code - low + sign * amount, F.lit(size)) + low)
        return (
            F.when(c.rlike("^[0-9]$"), shift(48, 10))
            .when(c.rlike("^[a-z]$"), shift(97, 26))
            .when(c.rlike("^[A-Z]$"), shift(65, 26))
            .otherwise(c)
        )

    def step(half: Column, other: Column, i: Column) -> Column:
        def through(digest: Column) -> Column:
            at = lambda j: F.conv(F.substring(digest, 1 + 2 * (j % 64), F.lit(2)), 16, 10).cast("int")
            return F.array_join(F.transform(F.split(half, ""), lambda c, j: moved(c, at(j))), "")

        return F.when(F.length(half) == 0, half).otherwise(
            _bind(_digest(key, i.cast("string"), F.length(half).cast("string"), other), through)
        )

    def run(v: Column) -> Column:
        n = F.length(v)
        # an even number of rounds: the sides end with the lengths they began with
        left, right = F.substring(v, F.lit(1), F.floor(n / 2).cast("int")), F.substring(v, F.floor(n / 2).cast("int") + 1, n)
        done = _network(F.struct(left.alias("l"), right.alias("r")), step, inverse)
        return _bind(done, lambda d: F.concat(d["l"], d["r"]))

    return _bind(value, run)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refill(value: Column, digits: Column) -> Column:
    """The value with its digits replaced, one by one, by the given ones."""
    return _bind(
        digits,
        lambda new: F.array_join(
            F.transform(
                F.split(value, ""),
                lambda c, j: F.when(
                    c.rlike("^[0-9]$"),
                    F.substring(new, F.length(_digits(F.substring(value, F.lit(1), j))) + 1, F.lit(1)),
                ).otherwise(c),
            ),
            "",
        ),
    )


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits whose last one has weight one."""
    return F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, j: F.struct(c.cast("int").alias("d"), j.alias("j"))),
        F.lit(0),
        lambda s, x: s
        + F.when(x["j"] % 2 == 0, x["d"]).otherwise(2 * x["d"] - F.when(x["d"] > 4, 9).otherwise(0)),
    )


def valid_card(value: Column) -> Column:
    digits = _digits(value)
    return F.length(digits).between(13, 19) & (_luhn_sum(digits) % 10 == 0)


def permute_card(value: Column, key: str, inverse: bool = False) -> Column:
    """Another number with a right check digit."""
    digits = _digits(value)
    body = permute_characters(F.substring(digits, F.lit(1), F.length(digits) - 1), key, inverse)
    check = lambda b: F.pmod(10 - _luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")
    return _refill(value, _bind(body, lambda b: F.concat(b, check(b))))


def _mod_97(text: Column) -> Column:
    """The remainder of a number written in digits and letters A = 10 … Z = 35."""
    return F.aggregate(
        F.split(text, ""),
        F.lit(0),
        lambda r, c: F.when(c.rlike("^[0-9]$"), (r * 10 + F.ascii(c) - 48) % 97).otherwise(
            (r * 100 + F.ascii(c) - 55) % 97
        ),
    )


def valid_iban(value: Column) -> Column:
    flat = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(flat, F.lit(5), F.length(flat)), F.substring(flat, F.lit(1), F.lit(4)))
    return F.length(flat).between(15, 34) & (_mod_97(turned) == 1)


def permute_iban(value: Column, key: str, inverse: bool = False) -> Column:
    """The same country, another account of the same shape, and the check digits it needs."""
    flat = F.replace(value, F.lit(" "), F.lit(""))
    body = permute_characters(F.substring(flat, F.lit(5), F.length(flat)), key, inverse)
    country = F.substring(value, F.lit(1), F.lit(2))

    def written(b: Column) -> Column:
        check = F.lpad((98 - _mod_97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
        whole = F.concat(country, check, b)
        put = F.transform(
            F.split(value, ""),
            lambda c, j: F.when(c == " ", c).otherwise(
                F.substring(whole, F.length(F.replace(F.substring(value, F.lit(1), j), F.lit(" "), F.lit(""))) + 1, F.lit(1))
            ),
        )
        return F.array_join(put, "")

    return _bind(body, written)


def valid_ipv4(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda o: o.cast("int") <= 255)


def permute_ipv4(value: Column, key: str, inverse: bool = False) -> Column:
    """Another address, by a network over its two halves of 16 bits."""
    sign = -1 if inverse else 1

    def run(o: Column) -> Column:
        start = F.struct((o[0] * 256 + o[1]).alias("l"), (o[2] * 256 + o[3]).alias("r"))
        step = lambda a, b, i: F.pmod(
            a + sign * _number(key, 65536, F.lit("ip"), i.cast("string"), b.cast("string")), F.lit(65536)
        )
        done = _network(start, step, inverse)
        byte = lambda x, low: (F.pmod(x, F.lit(256)) if low else F.floor(x / 256)).cast("string")
        return _bind(done, lambda d: F.concat_ws(".", byte(d["l"], 0), byte(d["l"], 1), byte(d["r"], 0), byte(d["r"], 1)))

    return _bind(F.transform(F.split(value, r"\."), lambda x: x.cast("bigint")), run)


#: the calendar repeats after 400 years, which are 146,097 = 189 * 773 days
CYCLE_DAYS, CYCLE_LEFT, CYCLE_RIGHT = 146_097, 189, 773

#: first day of the cycle of 1800 to 2199, in days since 1970-01-01
CYCLE_START = -62_091


def permute_date(date: Column, key: str, inverse: bool = False) -> Column:
    """Another day of the same 400 years (… 1800 to 2199, 2200 to 2599 …), by a network over Z189 x Z773."""
    sign = -1 if inverse else 1

    def run(day: Column) -> Column:
        cycle, place = F.floor(day / CYCLE_DAYS), F.pmod(day, F.lit(CYCLE_DAYS))
        acc = F.struct(F.floor(place / CYCLE_RIGHT).alias("l"), F.pmod(place, F.lit(CYCLE_RIGHT)).alias("r"))

        def turn(a: Column, i: Column) -> Column:
            shift = lambda x, y, m, tag: F.pmod(
                x + sign * _number(key, m, F.lit(tag), i.cast("string"), y.cast("string")), F.lit(m)
            )
            if inverse:
                return _bind(
                    shift(a["r"], a["l"], CYCLE_RIGHT, "dr"),
                    lambda r: F.struct(shift(a["l"], r, CYCLE_LEFT, "dl").alias("l"), r.alias("r")),
                )
            return _bind(
                shift(a["l"], a["r"], CYCLE_LEFT, "dl"),
                lambda l: F.struct(l.alias("l"), shift(a["r"], l, CYCLE_RIGHT, "dr").alias("r")),
            )

        rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))
        done = F.aggregate(rounds, acc, turn)
        return _bind(
            done,
            lambda d: F.date_from_unix_date(
                (cycle * CYCLE_DAYS + d["l"] * CYCLE_RIGHT + d["r"] + CYCLE_START).cast("int")
            ),
        )

    return _bind(F.unix_date(date).cast("bigint") - CYCLE_START, run)


#: a walk of so many steps ends before with a probability of all but 1e-25
MOST_STEPS = 64


def permute_day_first(date: Column, key: str, inverse: bool = False) -> Column:
    """Another day after the twelfth of a month, of the same 400 years: the permutation of days is taken again until it gives one.

    Such a day, written day first, is no date month first, and stays so.
    """
    again = lambda d: permute_date(d, key, inverse)
    return F.aggregate(
        F.sequence(F.lit(2), F.lit(MOST_STEPS)), again(date), lambda d, _: F.when(F.dayofmonth(d) > 12, d).otherwise(again(d))
    )


def _whole(value: Column, pattern: str) -> Column:
    return value.rlike(f"^(?:{pattern})$")


def _parts(value: Column, key: str, inverse: bool) -> Column:
    """A match that runs past an IBAN or card number, group by group: from each group on the longest valid value is replaced, and
    the search goes on behind it. What is left stays as it is."""
    # each group with what stands before it
    groups = F.regexp_extract_all(value, F.lit("[ -]?[A-Z0-9]+"), F.lit(0))

    def run(own: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            def put(text: Column) -> Column:
                bare = F.regexp_replace(text, "^[ -]", "")
                iban, card = _whole(bare, IBAN) & valid_iban(bare), _whole(bare, CARD) & valid_card(bare)
                new = F.when(iban, permute_iban(bare, key, inverse)).when(card, permute_card(bare, key, inverse))
                return F.concat(F.regexp_extract(text, "^[ -]?", 0), new)

            spans = F.transform(
                F.sequence(F.size(own), i + 1, F.lit(-1)),
                lambda e: F.struct(e.alias("next"), put(F.array_join(F.slice(own, i + 1, e - i), "")).alias("text")),
            )
            as_it_is = F.struct((i + 1).alias("next"), F.get(own, i).alias("text"))
            chosen = F.coalesce(F.get(F.filter(spans, lambda s: s["text"].isNotNull()), F.lit(0)), as_it_is)
            added = _bind(
                chosen, lambda c: F.struct(c["next"].alias("next"), F.concat(acc["text"], c["text"]).alias("text"))
            )
            return F.when(i < acc["next"], acc).otherwise(added)

        start = F.struct(F.lit(0).alias("next"), F.lit("").alias("text"))
        return F.aggregate(F.sequence(F.lit(0), F.size(own) - 1), start, step, lambda acc: acc["text"])

    return _bind(groups, run)


def pseudonym(value: Column, key: str, inverse: bool = False) -> Column:
    """What a match of ``PATTERN`` becomes; a match that is none of the valid kinds stays as it is, but for valid IBANs and card
    numbers among its groups.

    Dates with slashes are read month first where that gives a date, else day first; either kind becomes one that is read the same way.
    """
    whole = lambda p: _whole(value, p)
    dated = lambda fmt: F.try_to_date(value, fmt)

    def date_as(fmt: str) -> Column:
        return F.date_format(permute_date(dated(fmt), key, inverse), fmt)

    small = F.lower(value)
    top = F.regexp_extract(small, r"(\.[a-z]+)$", 1)
    # the top-level domain stays, so that the result looks like an address
    address = F.concat(
        permute_characters(F.substring(small, F.lit(1), F.length(small) - F.length(top)), key, inverse), top
    )
    # a network of its own for each number of digits, as the halves enter by their lengths
    digits = _refill(value, permute_characters(_digits(value), key, inverse))
    return (
        F.when(whole(EMAIL), address)
        .when(whole(ISO_DATE) & dated("yyyy-MM-dd").isNotNull(), date_as("yyyy-MM-dd"))
        .when(whole(DAY_FIRST) & dated("dd.MM.yyyy").isNotNull(), date_as("dd.MM.yyyy"))
        .when(whole(SLASHED) & dated("MM/dd/yyyy").isNotNull(), date_as("MM/dd/yyyy"))
        .when(
            whole(SLASHED) & dated("dd/MM/yyyy").isNotNull(),
            F.date_format(permute_day_first(dated("dd/MM/yyyy"), key, inverse), "dd/MM/yyyy"),
        )
        .when(whole(IPV4) & valid_ipv4(value), permute_ipv4(value, key, inverse))
        .when(whole(IBAN) & valid_iban(value), permute_iban(value, key, inverse))
        .when(whole(CARD) & valid_card(value), permute_card(value, key, inverse))
        .when(whole(PHONE) | whole(SSN), digits)
        .when(whole(IBAN) | whole(CARD), _parts(value, key, inverse))
        .otherwise(value)
    )


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """One row per document: ``doc_id, text, n_values, n_changed``.

    E-mail addresses, IBANs, dates, IPv4 addresses, phone numbers, social security numbers and card numbers in the whole
    text are replaced; ``n_values`` counts the matches, ``n_changed`` those that another value stands for now. A null text
    stays null with counts 0; an empty one stays empty. Repeated rows are treated alike. Other columns are not read.
    Numbers that fail their check (a card's Luhn digit, an octet above 255, no day of the calendar) stay.
    """
    text = F.col("text")
    # the cheap test spares texts without digits or @ the search
    worth = text.rlike("[0-9@]")
    found = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "text",
        F.when(worth, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).alias("found"),
    )
    new = found.withColumn("new", F.transform("found", lambda m: pseudonym(m, key)))
    woven = F.array_join(
        F.zip_with(F.split(text, PATTERN, -1), F.col("new"), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), ""
    )
    changed = F.size(F.filter(F.zip_with("found", "new", lambda a, b: a != b), lambda x: x))
    return new.select(
        "doc_id",
        F.when(F.size("found") > 0, woven).otherwise(text).alias("text"),
        F.when(worth, F.size("found")).otherwise(0).cast("bigint").alias("n_values"),
        F.when(worth, changed).otherwise(0).cast("bigint").alias("n_changed"),
    )
