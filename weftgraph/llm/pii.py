"""Format-preserving Feistel pseudonyms for personal data, in SQL expressions only.

Card numbers (Luhn-valid, 13 to 19 digits, in groups of four or as 4-6-5), telephone numbers written as in North
America (with any digits) or with a plus sign (8 to 15 digits), social security numbers, account numbers
(IBAN of the listed countries, valid mod 97), IPv4 and IPv6 addresses (of three groups or more, one with a digit), calendar dates
(1800 to 2199; a date with slashes is day first if it can be) and the local part of e-mail addresses are found by one pattern and
validated. Each valid value is ranked inside its format's domain of ``a * b`` values
and sent through an unbalanced Feistel network over Z_a x Z_b whose round function is a
keyed SHA-256, so the result is a valid value of the same format, equal values
stay equal in every document, and different values stay different. Values that are
strings (local parts, account numbers, IPv6) have a network over their two halves, each
character staying in its class. One-character local parts never stay as they are. There is no
shuffle: each row is rewritten where it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

# The formats that are recognised.
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
DATE = r"\d{4}-\d{2}-\d{2}(?![\w-])|\d{2}/\d{2}/\d{4}(?![\w/])|\d{2}\.\d{2}\.\d{4}(?![\w.]\d)"
IPV4 = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)"
CARD = r"(?:\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|\d{4}[ -]\d{6}[ -]\d{4,5})(?!\w|-\d)"
PHONE = r"(?:\+?1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w|-\d)"
PLUS = r"\+[1-9]\d{0,2}(?:[ .-]?\(?\d{2,4}\)?){2,6}(?!\w|-\d)"
SSN = r"\d{3}-\d{2}-\d{4}(?!\w|-\d)"
GROUP = "[0-9A-Fa-f]{1,4}"
IPV6 = rf"(?<!:)(?:(?:{GROUP}:){{7}}{GROUP}|(?:{GROUP}(?::{GROUP}){{0,6}})?::(?:{GROUP}(?::{GROUP}){{0,6}})?)(?![\w:]|\.\d)"
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH DE GB GE IE ME RS", 23: "AE GI IL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR PS QA", 30: "JO KW MU", 31: "MT SC",
}
IBAN = "(?:" + "|".join(f"(?:{names.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTHS.items()) + r")(?!\w)"
FOUND = rf"(?<![\w.%+-])(?:{EMAIL}|{IBAN}|{IPV6}|{DATE}|{IPV4}|{CARD}|{SSN}|{PHONE}|{PLUS})"
# Every format has one of these.
QUICK = "[0-9]{2}|@|[0-9][.][0-9]|:[0-9A-Fa-f]{0,4}:"
DATE_FORMATS = {r"^\d{4}-": "yyyy-MM-dd", r"^\d{2}/": "dd/MM/yyyy", r"^\d{2}\.": "dd.MM.yyyy"}
# A day number in the 400-year cycle 1800..2199 is a pair from Z_189 x Z_773.
DATE_A, DATE_B, DATE_FROM = 189, 773, "1800-01-01"
# Days 13 to 31 of that cycle, which can only be month first: 9 * 9833 of them.
LATE_A, LATE_B = 9, 9833
HEX = "0123456789abcdef"


def _sql(template: str, **parts: str) -> str:
    for name, value in parts.items():
        template = template.replace(f"<{name}>", value)
    return template


def _feistel(kind: str, rank: str, a: str, b: str, key: str) -> str:
    """SQL for the image of ``rank`` under the keyed permutation of Z_a x Z_b."""
    return _sql(
        """aggregate(sequence(0, <last>),
             named_struct('l', (<rank>) div (<b>), 'r', (<rank>) % (<b>)),
             (s, i) -> named_struct(
               'l', if(i % 2 = 0, (s.l + <f_r>) % (<a>), s.l),
               'r', if(i % 2 = 1, (s.r + <f_l>) % (<b>), s.r)),
             s -> s.l * (<b>) + s.r)""",
        f_r=_round("s.r", kind, key, "i"),
        f_l=_round("s.l", kind, key, "i"),
        last=str(ROUNDS - 1),
        rank=rank,
        a=a,
        b=b,
    )


def _round(value: str, kind: str, key: str, i: str) -> str:
    return f"cast(conv(substr(sha2(concat_ws('|', {key}, '{kind}', {i}, {value}), 256), 1, 13), 16, 10) as bigint)"


def _luhn_sum(digits: str) -> str:
    """Luhn sum of a digit string whose last digit is the check digit."""
    return (
        f"aggregate(sequence(1, length({digits})), 0, (t, i) -> t + "
        f"if((length({digits}) - i) % 2 = 0, cast(substr({digits}, i, 1) as int), "
        f"cast(substr('0246813579', cast(substr({digits}, i, 1) as int) + 1, 1) as int)))"
    )


def _let(value: str, name: str, body: str) -> str:
    """SQL ``let name = value in body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _remask(match: str, digits: str) -> str:
    """Put ``digits`` where ``match`` has digits; everything else stays."""
    return (
        f"array_join(transform(sequence(1, length({match})), p -> if(substr({match}, p, 1) rlike '[0-9]', "
        f"substr({digits}, length(regexp_replace(substr({match}, 1, p), '[^0-9]', '')), 1), substr({match}, p, 1))), '')"
    )


def _card(m: str, key: str) -> str:
    body = "lpad(cast(x as string), length(d) - 1, '0')"
    rank = "cast(substr(d, 1, length(d) - 1) as bigint)"
    # 10^ceil and 10^floor of half the digits: together all strings of length(d) - 1 digits
    a, b = "cast(pow(10, ceil((length(d) - 1) / 2)) as bigint)", "cast(pow(10, floor((length(d) - 1) / 2)) as bigint)"
    check = f"concat(w, cast((10 - {_luhn_sum("concat(w, '0')")} % 10) % 10 as string))"
    image = _let(_feistel("card", rank, a, b, key), "x", _let(body, "w", _remask(m, check)))
    return _let(f"regexp_replace({m}, '[^0-9]', '')", "d", image)


def _phone(m: str, key: str) -> str:
    """Numbers whose area code and exchange begin with 2 to 9 keep that; all others are permuted among themselves."""
    area, exchange, line = (f"cast(substr(t, {k}, {n}) as bigint)" for k, n in ((1, 3), (4, 3), (7, 4)))
    head = "substr(d, 1, length(d) - 10)"
    # area 200..999, exchange 200..999, line 0000..9999: 6.4e9 numbers = 80000 x 80000
    rank = f"(({area} - 200) * 800 + {exchange} - 200) * 10000 + {line}"
    new = f"concat({head}, cast(200 + x div 8000000 as string), cast(200 + (x div 10000) % 800 as string), lpad(cast(x % 10000 as string), 4, '0'))"
    valid = _let(_feistel("phone", rank, "80000L", "80000L", key), "x", _remask(m, new))
    # area 000..199 with any exchange, then area 200..999 with exchange 000..199: 3.6e9 numbers = 60000 x 60000
    rank = f"if({area} < 200, {area} * 1000 + {exchange}, 200000 + ({area} - 200) * 200 + {exchange}) * 10000 + {line}"
    prefix = "x div 10000"
    prefix = f"if({prefix} < 200000, {prefix}, 200000 + ({prefix} - 200000) div 200 * 1000 + ({prefix} - 200000) % 200)"
    new = f"concat({head}, lpad(cast({prefix} as string), 6, '0'), lpad(cast(x % 10000 as string), 4, '0'))"
    other = _let(_feistel("phone-other", rank, "60000L", "60000L", key), "x", _remask(m, new))
    image = _let("right(d, 10)", "t", f"if({area} >= 200 and {exchange} >= 200, {valid}, {other})")
    return _let(f"regexp_replace({m}, '[^0-9]', '')", "d", image)


def _ssn(m: str, key: str) -> str:
    image = _let(_feistel("ssn", "cast(d as bigint)", "100000L", "10000L", key), "x", _remask(m, "lpad(cast(x as string), 9, '0')"))
    return _let(f"regexp_replace({m}, '[^0-9]', '')", "d", image)


def _ipv4(m: str, key: str) -> str:
    octet = lambda i: f"cast(split({m}, '[.]')[{i}] as bigint)"
    rank = f"{octet(0)} * 16777216 + {octet(1)} * 65536 + {octet(2)} * 256 + {octet(3)}"
    return _let(_feistel("ipv4", rank, "65536L", "65536L", key), "x", "concat_ws('.', x div 16777216, (x div 65536) % 256, (x div 256) % 256, x % 256)")


def _date(m: str, key: str) -> str:
    out = m
    for start, fmt in DATE_FORMATS.items():
        rank = f"datediff(try_to_date({m}, '{fmt}'), date'{DATE_FROM}')"
        image = _let(_feistel("date", f"cast({rank} as bigint)", f"{DATE_A}L", f"{DATE_B}L", key), "x", f"date_format(date_add(date'{DATE_FROM}', cast(x as int)), '{fmt}')")
        out = f"if({m} rlike r'{start}', {image}, {out})"
    return out


def _month_first(m: str, key: str) -> str:
    """Dates with slashes that are none day first: their day is 13 to 31, and stays so."""
    start = lambda k: f"(datediff(add_months(date'{DATE_FROM}', {k}), date'{DATE_FROM}') - 12 * {k})"
    month = f"((year(t) - {DATE_FROM[:4]}) * 12 + month(t) - 1)"
    rank = f"cast({start(month)} + day(t) - 13 as bigint)"
    # about 18.4 such days a month
    at = f"array_max(filter(sequence(greatest(0, cast(x / 18.4369 as int) - 3), cast(x / 18.4369 as int) + 3), k -> {start('k')} <= x))"
    image = _let(at, "k", f"date_format(date_add(add_months(date'{DATE_FROM}', k), cast(x - {start('k')} + 12 as int)), 'MM/dd/yyyy')")
    return _let(f"try_to_date({m}, 'MM/dd/yyyy')", "t", _let(_feistel("date-late", rank, f"{LATE_A}L", f"{LATE_B}L", key), "x", image))


def _plus(m: str, key: str) -> str:
    """International numbers keep their first two digits, which hold most country codes."""
    n = "(length(d) - 2)"
    a, b = f"cast(pow(10, ceil({n} / 2)) as bigint)", f"cast(pow(10, floor({n} / 2)) as bigint)"
    image = _let(_feistel("plus", "cast(substr(d, 3) as bigint)", a, b, key), "x", _let(f"concat(substr(d, 1, 2), lpad(cast(x as string), {n}, '0'))", "w", _remask(m, "w")))
    return _let(f"regexp_replace({m}, '[^0-9]', '')", "d", image)


def _characters(u: str, kind: str, tweak: str, key: str, hexadecimal: bool = False) -> str:
    """SQL: a character-wise Feistel network over the two halves of a string.

    Letters stay letters of the same case, digits stay digits, marks stay; hexadecimal: digits of base 16.
    """

    def shifted(half: str, other: str) -> tuple[str, str]:
        stream = f"sha2(concat_ws('|', {key}, '{kind}', i, {tweak}, length({half}), {other}), 512)"
        moved = "case when c between 48 and 57 then chr(48 + (c - 48 + k) % 10) when c between 97 and 122 then chr(97 + (c - 97 + k) % 26) when c between 65 and 90 then chr(65 + (c - 65 + k) % 26) else chr(c) end"
        if hexadecimal:
            moved = f"substr('{HEX}', 1 + (instr('{HEX}', chr(c)) - 1 + k) % 16, 1)"
        return (
            f"array_join(transform(sequence(1, length({half})), j -> if(length({half}) = 0, '', "
            + _let(f"ascii(substr({half}, j, 1))", "c", _let("cast(conv(substr(z, 1 + 2 * ((j - 1) % 64), 2), 16, 10) as int)", "k", moved))
            + ")), '')"
        ), stream

    left, ls = shifted("s.l", "s.r")
    right, rs = shifted("s.r", "s.l")
    return f"""aggregate(sequence(0, {ROUNDS - 1}),
        named_struct('l', substr({u}, 1, length({u}) div 2), 'r', substr({u}, length({u}) div 2 + 1)),
        (s, i) -> named_struct(
          'l', if(i % 2 = 0 and length(s.l) > 0, {_let(ls, 'z', left)}, s.l),
          'r', if(i % 2 = 1, {_let(rs, 'z', right)}, s.r)),
        s -> concat(s.l, s.r))"""


def _email(m: str, key: str) -> str:
    """The local part; the domain stays and is part of the key. A single letter or digit is moved by a step that isn't zero."""
    step = f"cast(conv(substr(sha2(concat_ws('|', {key}, 'email-1', lower(h)), 256), 1, 8), 16, 10) as bigint)"
    moved = lambda first, n: f"chr(cast({first} + (ascii(u) - {first} + 1 + {step} % {n - 1}) % {n} as int))"
    one = f"case when u between '0' and '9' then {moved(48, 10)} when u between 'a' and 'z' then {moved(97, 26)} when u between 'A' and 'Z' then {moved(65, 26)} else u end"
    image = f"concat(if(length(u) = 1, {one}, {_characters('u', 'email', 'lower(h)', key)}), '@', h)"
    return _let(f"substring_index({m}, '@', 1)", "u", _let(f"substring_index({m}, '@', -1)", "h", image))


def _mod97(text: str) -> str:
    return f"aggregate(transform(sequence(1, length({text})), i -> substr({text}, i, 1)), 0, (t, y) -> if(y between '0' and '9', t * 10 + cast(y as int), t * 100 + ascii(y) - 55) % 97)"


def _iban(m: str, key: str) -> str:
    """Country and shape stay; the check digits are made anew."""
    check = _let("concat(x, substr(d, 1, 2), '00')", "w", f"lpad(cast(98 - {_mod97('w')} as string), 2, '0')")
    whole = _let(check, "v", _let("concat(substr(d, 1, 2), v, x)", "w", f"array_join(transform(sequence(1, length({m})), p -> if(substr({m}, p, 1) = ' ', ' ', substr(w, length(replace(substr({m}, 1, p), ' ', '')), 1))), '')"))
    return _let(f"replace({m}, ' ', '')", "d", _let("substr(d, 5)", "u", _let(_characters("u", "iban", "substr(d, 1, 2)", key), "x", whole)))


def _ipv6(m: str, key: str) -> str:
    """Of any spelling of the address the same eight groups."""
    groups = lambda at: f"filter(split(substring_index(lower({m}), '::', {at}), ':'), y -> y <> '')"
    right = f"if({m} like '%::%', {groups(-1)}, cast(array() as array<string>))"
    full = f"array_join(transform(concat(a, array_repeat('0', 8 - size(a) - size(b)), b), y -> lpad(y, 4, '0')), '')"
    image = _let(full, "u", f"regexp_replace({_characters('u', 'ipv6', chr(39) * 2, key, True)}, '(....)(?!$)', '$1:')")
    return _let(groups(1), "a", _let(right, "b", image))


def _kind(m: str) -> str:
    """The format of a match, or null if the value isn't valid in it."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    dates = " or ".join(f"({m} rlike r'{s}' and try_to_date({m}, '{f}') between date'1800-01-01' and date'2199-12-31')" for s, f in DATE_FORMATS.items())
    late = f"try_to_date({m}, 'MM/dd/yyyy') between date'1800-01-01' and date'2199-12-31'"
    groups = f"size(filter(split({m}, ':'), y -> y <> ''))"
    turned = _let(f"replace({m}, ' ', '')", "d", _let("concat(substr(d, 5), substr(d, 1, 4))", "w", _mod97("w")))
    return f"""case
      when {m} like '%@%' then 'email'
      when {m} rlike r'^(?:{IBAN})$' then if({turned} = 1, 'iban', null)
      when {m} rlike r'^(?:{IPV6})$' then if({groups} between 3 and if({m} like '%::%', 7, 8) and {m} rlike '[0-9]', 'ipv6', null)
      when {m} rlike r'^(?:{DATE})$' then if({dates}, 'date', if({m} like '%/%' and {late}, 'date-late', null))
      when {m} rlike r'^(?:{IPV4})$' then if(forall(split({m}, '[.]'), o -> cast(o as int) <= 255), 'ipv4', null)
      when {m} rlike r'^(?:{SSN})$' then 'ssn'
      when {m} rlike r'^(?:{PHONE})$' then 'phone'
      when {m} like '+%' then if(length({digits}) = 11 and {m} like '+1%', 'phone', if(length({digits}) between 8 and 15, 'plus', null))
      when length({digits}) between 13 and 19 and {_luhn_sum(digits)} % 10 = 0 then 'card'
    end"""


def pseudonym(m: str, key: str) -> str:
    """SQL: the pseudonym of one match (an expression or lambda variable), itself if invalid."""
    return _let(
        _kind(m),
        "kind",
        f"""named_struct('kind', kind, 'value', case kind
          when 'email' then {_email(m, key)} when 'date' then {_date(m, key)} when 'ipv4' then {_ipv4(m, key)}
          when 'ssn' then {_ssn(m, key)} when 'phone' then {_phone(m, key)} when 'card' then {_card(m, key)}
          when 'date-late' then {_month_first(m, key)} when 'plus' then {_plus(m, key)} when 'iban' then {_iban(m, key)} when 'ipv6' then {_ipv6(m, key)}
          else {m} end)""",
    )


def pseudonymise(df: DataFrame, key: str, text: str = "text", n_found: str = "n_found") -> DataFrame:
    """Replace every valid personal value in ``text`` and count the replacements in ``n_found``.

    All rows and all other columns stay. A null text stays null with 0 found, an
    empty one stays empty; values that fail validation stay as they are. ``key``
    is a secret string; the same key gives the same pseudonyms in every run.
    Repeated rows are treated alike. A column already called ``n_found`` is replaced.
    """
    secret = "'" + key.replace("\\", "\\\\").replace("'", "\\'") + "'"
    column = f"`{text}`"
    quick = F.expr(f"{column} rlike r'{QUICK}'")
    found = F.expr(f"regexp_extract_all({column}, r'{FOUND}', 0)")
    matches = F.when(quick, found).otherwise(F.array().cast("array<string>"))
    staged = df.withColumn("__w_matches", matches)
    staged = staged.withColumn("__w_new", F.expr(f"if(size(__w_matches) > 0, transform(__w_matches, m -> {pseudonym('m', secret)}), null)"))
    pieces = f"split({column}, r'{FOUND}', -1)"
    joined = f"concat(array_join(zip_with(slice({pieces}, 1, size(__w_new)), __w_new, (p, n) -> concat(p, n.value)), ''), element_at({pieces}, -1))"
    staged = staged.withColumn(n_found, F.expr("cast(if(__w_new is null, 0, size(filter(__w_new, n -> n.kind is not null))) as bigint)"))
    staged = staged.withColumn(text, F.when(F.col("__w_new").isNotNull(), F.expr(joined)).otherwise(F.col(column)))
    return staged.drop("__w_matches", "__w_new")
