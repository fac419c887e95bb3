"""Format-preserving pseudonyms for personal numbers, dates and addresses.

A validated value is read as a list of small whole numbers with fixed radices (digits of
a card, octets of an address, day within 400 years, …). A keyed Feistel network permutes
the list: each round adds to one half, number by number and modulo its radix, a hash of
the key, the kind, the round and the other half. The network is a permutation of all
valid values of a format, so equal values get equal pseudonyms in every document, and
different values different ones. Separators and lengths stay.

| kind | validated by | permuted |
| --- | --- | --- |
| card | 13 to 19 digits in whole groups, Luhn sum | all digits but the last, which is set anew |
| ssn | area 1-899 without 666, group and serial not 0 | area, group, serial |
| phone | country code and ten digits, or a country code of the numbering plan and 7 to 15 digits in all | the digits behind the country code |
| ip | four octets up to 255 | the octets |
| date | real day in the years 1800 to 2199, month first if day first is none | the day within the 400 years |
| email | letters, digits before the @ | letters among letters, digits among digits; the domain stays |

Cards are sought in stretches of digit groups with single spaces or hyphens between, which
end where a value of another kind begins. First the usual layouts count (one group, 4-4-4-4,
4-6-5, 4-6-4), then any groups in a row, longest first; what no valid card covers stays.
A month-first date keeps its layout, so its pseudonym may read like a day-first one.

Only built-in column functions are used. The key is a parameter; whoever holds it can
recompute pseudonyms, so production passes its own.

Defined cases: a null text stays null and counts 0; values that fail validation stay as
they are; rows are rewritten one by one, so repeated rows agree; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyline.llm.columns import matches, pieces
from eddyline.llm.common import fresh, table

KEY = "pseudonym key 1"
ROUNDS = 8
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
DATE = r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9])"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
PHONE = r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
OTHERS = "|".join((EMAIL, DATE, IP, SSN))
CODE = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
ABROAD = rf"(?<![0-9+])\+(?=(?:[^0-9\n]{{0,3}}[0-9]){{7}})[1-9](?:(?:[ .-](?!{OTHERS}))?(?:\(0\)[ .-]?)?\(?[0-9]\)?){{6,14}}(?![0-9]|[/:][0-9])"
#: Groups of digits that hold 13 digits at least, up to a value of another kind.
GROUPS = rf"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]+(?:[ -](?!{OTHERS})[0-9]+)*+"
LAYOUTS = {1: "^[0-9]{13,19}$", 4: "^[0-9]{4}(?: [0-9]{4}){3}$", 3: "^[0-9]{4} [0-9]{6} [0-9]{4,5}$"}
KINDS = ("email", "date", "ip", "phone", "ssn", "card")
PATTERNS = dict(zip(KINDS, (EMAIL, DATE, IP, f"{PHONE}|{ABROAD}", SSN, GROUPS)))
ANY = "|".join(PATTERNS.values())
DAYS_400_YEARS = 146_097  # 189 * 773


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def feistel(values: Column, radices: Column, kind: str, key: str, rounds: int = ROUNDS) -> Column:
    """The permuted list; ``values`` are whole numbers below their ``radices``."""

    def half(s: Column, first: bool, number: int) -> Column:
        """The half that changes in a round."""
        own, other = (s["a"], s["b"]) if first else (s["b"], s["a"])
        limit = s["ra"] if first else s["rb"]
        salt = F.concat(F.lit(f"{key}|{kind}|{number}|"), F.array_join(F.transform(other, lambda v: v.cast("string")), ","))
        drawn = F.transform(limit, lambda r, i: F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", salt, i.cast("string")), 256), 1, 15), 16, 10).cast("bigint"), r.cast("bigint")))
        return F.zip_with(F.zip_with(own, drawn, lambda x, d: x + d), limit, lambda t, r: F.pmod(t, r.cast("bigint")))

    size = F.size(values)
    cut = F.floor(size / 2).cast("int")
    longs = F.transform(values, lambda v: v.cast("bigint"))
    state = F.struct(F.slice(longs, 1, cut).alias("a"), F.slice(longs, cut + 1, size - cut).alias("b"), F.slice(radices, 1, cut).alias("ra"), F.slice(radices, cut + 1, size - cut).alias("rb"))
    steps = F.array(state)
    for number in range(rounds):
        steps = F.transform(steps, _round(half, number % 2 == 0, number))
    return F.transform(steps, lambda s: F.concat(s["a"], s["b"]))[0]


def _round(half, first: bool, number: int):
    def step(s: Column) -> Column:
        changed = half(s, first, number)
        a, b = (changed, s["b"]) if first else (s["a"], changed)
        return F.struct(a.alias("a"), b.alias("b"), s["ra"].alias("ra"), s["rb"].alias("rb"))

    return step


def digits(value: Column) -> Column:
    return F.transform(matches(value, "[0-9]"), lambda c: c.cast("int"))


def same(radix: int, count: Column) -> Column:
    return F.array_repeat(F.lit(radix), count.cast("int"))


def refill(shape: Column, symbols: Column, slot: str) -> Column:
    """``shape`` with its characters that match ``slot`` replaced by ``symbols`` in turn."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        fits = c.rlike(slot)
        return F.struct(F.concat(acc["out"], F.when(fits, F.try_element_at(symbols, acc["at"])).otherwise(c)).alias("out"), (acc["at"] + fits.cast("int")).alias("at"))

    return F.aggregate(matches(shape, "(?s)."), start, step, lambda acc: acc["out"])


def text_of(values: Column) -> Column:
    return F.transform(values, lambda v: v.cast("string"))


def luhn_sum(values: Column, skip: int) -> Column:
    """Luhn sum of digits; ``skip`` is the number of places to their right."""
    turned = F.reverse(values)
    weigh = lambda d, i: F.when((i + skip) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    return F.aggregate(F.transform(turned, weigh), F.lit(0).cast("bigint"), lambda a, d: a + d)


def _card(m: Column, key: str) -> Column:
    def swap(d: Column) -> Column:
        body = F.slice(d, 1, F.size(d) - 1)
        new = feistel(body, same(10, F.size(d) - 1), "card", key)
        return let(new, lambda n: F.concat(n, F.array(F.pmod(10 - luhn_sum(n, 1) % 10, F.lit(10)).cast("bigint"))))

    return let(digits(m), lambda d: F.when(luhn_sum(d, 0) % 10 == 0, refill(m, text_of(swap(d)), "[0-9]")))


def _luhn(number: Column) -> Column:
    return F.call_function("luhn_check", number)


def _first(tries: list[tuple[int, Column]]) -> Column:
    size = F.lit(0)
    for k, fits in reversed(tries):
        size = F.when(fits, F.lit(k)).otherwise(size)
    return size


def _cut(start: Column, end: Column, size) -> Column:
    """Stretches (at, n, card) that cover the groups from ``start`` to before ``end``:
    at each group, ``size`` says how many from there on are a card."""
    kind = "array<struct<at:int,n:int,card:boolean>>"
    stretch = lambda at, n, card: F.struct(at.cast("int").alias("at"), n.cast("int").alias("n"), F.lit(card).alias("card"))
    state = F.struct(start.cast("int").alias("next"), F.array().cast(kind).alias("out"))
    up_to = lambda out, last, i: F.when(i > last, F.array_append(out, stretch(last, i - last, False))).otherwise(out)

    def step(s: Column, i: Column) -> Column:
        found = lambda n: F.when(n > 0, F.struct((i + n).cast("int").alias("next"), F.array_append(up_to(s["out"], s["next"], i), stretch(i, n, True)).alias("out"))).otherwise(s)
        return F.when(i < s["next"], s).otherwise(let(size(i), found))

    return F.aggregate(F.sequence(start, end - 1), state, step, lambda s: up_to(s["out"], s["next"], end))


def _cards(m: Column, key: str) -> Column:
    """(kind, value, pseudonym, tail) of the cards in ``m`` and of what is between them."""

    def parts(g: Column) -> Column:
        digit = lambda at, n, sep="": F.array_join(F.slice(g, at + 1, F.lit(n)), sep)
        usual = lambda i: _first([(n, (i + n <= F.size(g)) & digit(i, n, " ").rlike(p) & _luhn(digit(i, n))) for n, p in LAYOUTS.items()])

        def other(end: Column):
            def size(i: Column) -> Column:
                fits = lambda n: (F.length(F.array_join(F.slice(g, i + 1, n), "")).between(13, 19)) & _luhn(F.array_join(F.slice(g, i + 1, n), ""))
                return F.coalesce(F.get(F.filter(F.sequence(F.least(end - i, F.lit(19)), F.lit(1), F.lit(-1)), fits), F.lit(0)), F.lit(0))

            return size

        whole = F.transform(_cut(F.lit(0), F.size(g), usual), lambda c: F.when(c["card"], F.array(c)).otherwise(_cut(c["at"], c["at"] + c["n"], other(c["at"] + c["n"]))))
        return F.flatten(whole)

    def part(text: Column, card: Column) -> Column:
        value = F.when(card, F.rtrim(text, F.lit(" -"))).otherwise(text)
        return let(value, lambda v: F.struct(F.lit("card").alias("kind"), v.alias("value"), F.when(card, _card(v, key)).alias("pseudonym"), F.substring(text, F.length(v) + 1, F.length(text)).alias("tail")))

    held = lambda h: F.transform(let(F.transform(h, lambda x: F.rtrim(x, F.lit(" -"))), parts), lambda c: let(F.array_join(F.slice(h, c["at"] + 1, c["n"]), ""), lambda t: part(t, c["card"])))
    return let(matches(m, "[0-9]+[ -]?"), held)


def _ssn(m: Column, key: str) -> Column:
    def swap(p: Column) -> Column:
        area = p[0] - 1 - (p[0] > 666).cast("int")
        new = feistel(F.array(area, p[1] - 1, p[2] - 1), F.array(F.lit(898), F.lit(99), F.lit(9999)), "ssn", key)
        pad = lambda v, n: F.lpad(v.cast("string"), n, "0")
        return let(new, lambda n: F.concat_ws("-", pad(n[0] + 1 + (n[0] >= 665).cast("int"), 3), pad(n[1] + 1, 2), pad(n[2] + 1, 4)))

    parts = F.transform(F.split(m, "-"), lambda v: v.cast("int"))
    return let(parts, lambda p: F.when((p[0] >= 1) & (p[0] <= 899) & (p[0] != 666) & (p[1] > 0) & (p[2] > 0), swap(p)))


def _phone(m: Column, key: str) -> Column:
    plain = F.regexp_replace(m, r"\(0\)|[^0-9]", "")
    code = F.when(m.rlike(f"^(?:{PHONE})$"), F.length(plain) - 10).otherwise(F.length(F.regexp_extract(plain, f"^{CODE}", 0)))

    def swap(d: Column, lead: Column) -> Column:
        new = feistel(F.slice(d, lead + 1, F.size(d) - lead), same(10, F.size(d) - lead), "phone", key)
        return F.concat(F.transform(F.slice(d, F.lit(1), lead), lambda v: v.cast("bigint")), new)

    shape = F.regexp_replace(m, r"\(0\)", "(o)")
    return F.regexp_replace(refill(shape, text_of(let(code, lambda n: let(digits(plain), lambda d: swap(d, n)))), "[0-9]"), r"\(o\)", "(0)")


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, "\\."), lambda v: v.cast("int"))
    return let(octets, lambda o: F.when(F.forall(o, lambda v: v <= 255), F.array_join(text_of(feistel(o, same(256, F.lit(4)), "ip", key)), ".")))


def _date(m: Column, key: str) -> Column:
    iso, slash = m.rlike("^[0-9]{4}-"), m.contains("/")
    month_first = ~iso & (F.substring(m, 4, 2) > "12")
    day, month = F.when(month_first, F.substring(m, 4, 2)).otherwise(F.substring(m, 1, 2)), F.when(month_first, F.substring(m, 1, 2)).otherwise(F.substring(m, 4, 2))
    layouts = ("yyyy-MM-dd", "MM/dd/yyyy", "MM.dd.yyyy", "dd/MM/yyyy", "dd.MM.yyyy")
    pick = lambda of: F.when(iso, of(layouts[0])).when(month_first & slash, of(layouts[1])).when(month_first, of(layouts[2])).when(slash, of(layouts[3])).otherwise(of(layouts[4]))
    plain = F.when(iso, m).otherwise(F.concat_ws("-", F.substring(m, 7, 4), month, day))
    base = F.lit("1800-01-01").cast("date")

    def swap(n: Column) -> Column:
        new = feistel(F.array(F.floor(n / 773), n % 773), F.array(F.lit(189), F.lit(773)), "date", key)
        return let(new, lambda v: let(F.date_add(base, (v[0] * 773 + v[1]).cast("int")), lambda d: pick(lambda f: F.date_format(d, f))))

    return let(F.datediff(plain.try_cast("date"), base), lambda n: F.when((n >= 0) & (n < DAYS_400_YEARS), swap(n)))


def _email(m: Column, key: str) -> Column:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def swap(c: Column) -> Column:
        radices = F.transform(c, lambda x: F.when(x.rlike("[0-9]"), 10).otherwise(26))
        values = F.transform(c, lambda x: F.coalesce(F.nullif(F.instr(F.lit(low), x), F.lit(0)), F.nullif(F.instr(F.lit(up), x), F.lit(0)), F.instr(F.lit(num), x)) - 1)
        new = feistel(values, radices, "email", key)
        letter = lambda v, x: F.substring(F.when(x.rlike("[0-9]"), num).when(x.rlike("[a-z]"), low).otherwise(up), (v + 1).cast("int"), F.lit(1))
        return F.zip_with(new, c, letter)

    return let(matches(local, "[A-Za-z0-9]"), lambda c: F.when(F.size(c) > 0, F.concat(refill(local, swap(c), "[A-Za-z0-9]"), F.lit("@"), domain)))


SWAPS = {"email": _email, "date": _date, "ip": _ip, "phone": _phone, "ssn": _ssn}


def pseudonymise(df: DataFrame, text_col: str = "text", key: str = KEY) -> tuple[DataFrame, str]:
    """``df`` with its text rewritten, and one more column (its name is returned): array of
    (kind, value, pseudonym) in text order."""
    hold, name = fresh(df, "pii_row"), fresh(df, "pii_found")
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(hold), F.col(text_col).alias("t"))
    rows = rows.withColumn("m", F.coalesce(matches(F.col("t"), ANY), F.array().cast("array<string>"))).withColumn("p", pieces(F.col("t"), ANY, F.col("m")))

    part = "struct<kind:string,value:string,pseudonym:string,tail:string>"

    def judge(m: Column) -> Column:
        parts = _cards(m, key)
        for k in reversed(KINDS[:-1]):
            one = F.struct(F.lit(k).alias("kind"), m.alias("value"), SWAPS[k](m, key).alias("pseudonym"), F.lit("").alias("tail"))
            parts = F.when(m.rlike(f"^(?:{PATTERNS[k]})$"), F.array(one)).otherwise(parts)
        return parts

    empty = F.array().cast(f"array<array<{part}>>")
    rows = rows.withColumn("f", F.when(F.size("m") > 0, F.transform("m", judge)).otherwise(empty))
    told = lambda f: F.array_join(F.transform(f, lambda x: F.concat(F.coalesce(x["pseudonym"], x["value"]), x["tail"])), "")
    woven = F.zip_with(F.slice("p", 1, F.size("m")), "f", lambda p, f: F.concat(p, told(f)))
    text = F.when(F.size("m") > 0, F.concat(F.array_join(woven, ""), F.element_at("p", -1))).otherwise(F.col("t"))
    columns = [text.alias(c) if c == text_col else F.col(hold)[c].alias(c) for c in df.columns]
    found = F.transform(F.filter(F.flatten("f"), lambda f: f["pseudonym"].isNotNull()), lambda f: F.struct(f["kind"].alias("kind"), f["value"].alias("value"), f["pseudonym"].alias("pseudonym")))
    return rows.select(*columns, found.alias(name)), name


def op3_feistel_pseudonyms(spark, sf_dir: str) -> DataFrame:
    out, name = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of_kind = lambda k: F.size(F.filter(name, lambda f: f["kind"] == k)).cast("long")
    pairs = F.array_join(F.transform(name, lambda f: F.concat_ws(":", f["kind"], f["pseudonym"])), ",")
    return out.select("doc_id", *(of_kind(k).alias(f"n_{k}") for k in KINDS), pairs.alias("pseudonyms"), "text")
