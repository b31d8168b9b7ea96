"""Format-preserving pseudonyms for personal data, with SQL functions only.

Card numbers (Luhn), IPv4 addresses, calendar dates, social security and phone numbers are permuted within their format by a keyed
Feistel network: two halves, each in turn shifted by a keyed hash of the other, modulo its own range. That is a bijection of the format,
so equal values stay linked across documents and different ones never meet; valid numbers become valid ones. Left alone: dates other than yyyy-mm-dd standing free (a time after a T, 05/01/2024, 5 January 2024), and phone
numbers other than ten digits as 3-3-4 with separators, a country code before them or not. Mail addresses get a keyed digest. The key is a
parameter; who has it can undo the permutations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shiftscope.llm.common import unused

ROUNDS = 10
#: What is looked for. Every branch starts at a boundary and runs forward only, so a very long word is passed once.
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
ADDRESS = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)"
DATE = r"(?<![\w-])(?:17|18|19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\w-])"
SOCIAL = r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-])"
PHONE = r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w|[.-]\d)"
CARD = r"(?<![\w.+-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5})(?!\w|[.-]\d)"
KINDS = {"mail": MAIL, "address": ADDRESS, "date": DATE, "social": SOCIAL, "phone": PHONE, "card": CARD}
PATTERN = "|".join(f"(?:{p})" for p in (MAIL, ADDRESS, DATE, SOCIAL, CARD, PHONE))
#: 1700-01-01 to 2099-12-31 has 146,097 days, 27 times 5,411.
DAYS = 27, 5411


def _sql(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _permuted(a: str, b: str, m: str, n: str, tag: str, key: str) -> str:
    """struct(a, b) after the rounds; ``a`` is below ``m``, ``b`` below ``n``, all SQL expressions."""
    shift = f"cast(conv(substr(sha2(concat({_sql(key)}, ':', {tag}, ':', r, ':', {{}}), 256), 1, 15), 16, 10) as bigint)"
    even = f"named_struct('a', (s.a + {shift.format('s.b')}) % {m}, 'b', s.b)"
    odd = f"named_struct('a', s.a, 'b', (s.b + {shift.format('s.a')}) % {n})"
    return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (s, r) -> if(r % 2 = 0, {even}, {odd}))"


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _digits(d: str, tag: str, key: str) -> str:
    """A string of digits permuted among those of its length."""
    half, n = f"(length({d}) div 2)", f"length({d})"
    ten = lambda e: f"cast(pow(10, {e}) as bigint)"
    moved = _permuted(f"substr({d}, 1, {half})", f"substr({d}, {half} + 1)", ten(half), ten(f"({n} - {half})"), f"concat({_sql(tag)}, {n})", key)
    return _let(moved, "f", f"concat(lpad(f.a, {half}, '0'), lpad(f.b, {n} - {half}, '0'))")


def _social(d: str, key: str) -> str:
    """Nine digits permuted among valid ones: areas 001 to 899 but 666, groups from 01, serials from 0001."""
    area, group, serial = (f"cast(substr({d}, {a}, {n}) as bigint)" for a, n in ((1, 3), (4, 2), (6, 4)))
    moved = _permuted(f"if({area} > 666, {area} - 2, {area} - 1)", f"({group} - 1) * 9999 + {serial} - 1", "898", str(99 * 9999), "'social'", key)
    return _let(moved, "f", "concat(lpad(if(f.a < 665, f.a + 1, f.a + 2), 3, '0'), lpad(f.b div 9999 + 1, 2, '0'), lpad(f.b % 9999 + 1, 4, '0'))")


def _phone(d: str, key: str) -> str:
    """Ten digits permuted among those whose area and exchange codes start alike with 0 or 1, or with 2 to 9: only the latter are given out."""
    area, exchange, line = (f"cast(substr({d}, {a}, {n}) as bigint)" for a, n in ((1, 3), (4, 3), (7, 4)))
    first = lambda code: f"if({code} < 200, 0, 200)"
    many = lambda code: f"if({code} < 200, 200, 800)"
    moved = _permuted(f"{area} - {first(area)}", f"({exchange} - {first(exchange)}) * 10000 + {line}", many(area), f"({many(exchange)} * 10000)", "'phone'", key)
    return _let(moved, "f", f"concat(lpad(f.a + {first(area)}, 3, '0'), lpad(f.b div 10000 + {first(exchange)}, 3, '0'), lpad(f.b % 10000, 4, '0'))")


def _luhn(d: str) -> str:
    """Luhn sum of a string of digits."""
    digit = f"cast(substr({d}, length({d}) - i, 1) as int)"
    return f"aggregate(sequence(0, length({d}) - 1), 0, (t, i) -> t + if(i % 2 = 0, {digit}, 2 * {digit} - if({digit} > 4, 9, 0)))"


def _laid_out(x: str, d: str) -> str:
    """The digits ``d`` in the places of the digits of ``x``."""
    place = f"length(regexp_replace(substr({x}, 1, p), '[^0-9]', ''))"
    return f"array_join(transform(sequence(1, length({x})), p -> if(substr({x}, p, 1) rlike '[0-9]', substr({d}, {place}, 1), substr({x}, p, 1))), '')"


def _is(kind: str, x: str) -> str:
    whole = {"mail": ".*@.*", "address": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "date": "[0-9]{4}-[0-9]{2}-[0-9]{2}", "social": "[0-9]{3}-[0-9]{2}-[0-9]{4}", "card": "[0-9](?:[ -]?[0-9]){12,18}"}
    return f"{x} rlike {_sql('^(?:' + whole[kind] + ')$')}"


def _found(x: str) -> str:
    """Kind of a match, or null where the value isn't valid."""
    digits = f"regexp_replace({x}, '[^0-9]', '')"
    return (
        f"case when {_is('mail', x)} then 'mail' when {_is('address', x)} then 'address' when {_is('date', x)} then if(try_to_date({x}, 'yyyy-MM-dd') is null, null, 'date') "
        f"when {_is('social', x)} then 'social' when {_is('card', x)} then if(" + _let(digits, "d", f"{_luhn('d')} % 10 = 0") + ", 'card', null) else 'phone' end"
    )


def _pseudonym(x: str, key: str) -> str:
    mail = f"concat('u', substr(sha2(concat({_sql(key)}, ':mail:', lower({x})), 256), 1, 16), '@example.invalid')"
    octet = [f"cast(split({x}, '[.]')[{k}] as int)" for k in range(4)]
    address = _let(_permuted(f"256 * {octet[0]} + {octet[1]}", f"256 * {octet[2]} + {octet[3]}", "65536", "65536", "'address'", key), "f", "concat_ws('.', f.a div 256, f.a % 256, f.b div 256, f.b % 256)")
    day = f"datediff(to_date({x}, 'yyyy-MM-dd'), date'1700-01-01')"
    date = _let(_permuted(f"{day} div {DAYS[1]}", f"{day} % {DAYS[1]}", str(DAYS[0]), str(DAYS[1]), "'date'", key), "f", f"date_format(date_add(date'1700-01-01', cast(f.a * {DAYS[1]} + f.b as int)), 'yyyy-MM-dd')")
    digits = f"regexp_replace({x}, '[^0-9]', '')"
    card = _let(digits, "d", _let(_digits("substr(d, 1, length(d) - 1)", "card", key), "c", _laid_out(x, "concat(c, cast((10 - " + _luhn("concat(c, '0')") + " % 10) % 10 as string))")))
    social = _let(digits, "d", _let(_social("d", key), "c", _laid_out(x, "c")))
    phone = _let(digits, "d", _let(_phone("substr(d, length(d) - 9)", key), "c", _laid_out(x, "concat(substr(d, 1, length(d) - 10), c)")))
    kinds = {"mail": mail, "address": address, "date": date, "social": social, "card": card, "phone": phone}
    return "case k " + " ".join(f"when '{k}' then {v}" for k, v in kinds.items()) + f" else {x} end"


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", counts_col: str | None = "pii") -> DataFrame:
    """``docs`` with ``text_col`` rewritten and ``counts_col``, if asked for, added or replaced: the number of values replaced of each kind (map, kinds with none left out).

    Numbers that fail their check, and dates that don't exist, stay as they are, and so does all other text. A null text stays null, with
    an empty map. Rows are independent, repeated ones alike: one scan, no shuffle. Other columns stay, whatever their names.
    """
    if not key:
        raise ValueError("a key is needed")
    text, at, between = F.col(f"`{text_col}`"), unused(docs, "pii_at"), unused(docs, "pii_between")
    worth = text.rlike("[0-9@]")
    split = docs.withColumn(at, F.when(worth, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))).withColumn(between, F.when(F.size(at) > 0, F.split(text, PATTERN, -1)))
    values = split.withColumn(at, F.expr(f"transform({at}, x -> named_struct('x', x, 'k', {_found('x')}))"))
    new = F.expr(f"concat({between}[0], array_join(zip_with({at}, slice({between}, 2, size({between}) - 1), (v, t) -> concat({_let('v.k', 'k', _let('v.x', 'x', _pseudonym('x', key)))}, t)), ''))")
    kinds = F.array(*[F.struct(F.lit(k).alias("key"), F.expr(f"coalesce(size(filter({at}, v -> v.k = '{k}')), 0)").alias("value")) for k in sorted(KINDS)])
    counts = F.map_from_entries(F.filter(kinds, lambda e: e["value"] > 0))
    done = values.withColumn(text_col, F.when(F.size(at) > 0, new).otherwise(text))
    return (done.withColumn(counts_col, counts) if counts_col else done).drop(at, between)
