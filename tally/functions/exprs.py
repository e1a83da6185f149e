"""Column expressions shared by the operators: money, dates, ageing, scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the scorer: weights without and with counterparty evidence.
WEIGHTS_3 = (0.6, 0.3, 0.1)
WEIGHTS_4 = (0.5, 0.25, 0.1, 0.15)
DATE_SPAN = 30


def money_to_minor(text: Column) -> Column:
    """Decimal text to minor units, null where it is no amount.

    Takes an optional sign or parentheses for negatives, thousands commas and
    at most two decimals; a sign inside parentheses is ambiguous and null.
    """
    shape = r"^([+-]?)([0-9]*)(?:\.([0-9]{0,2}))?$"
    null = F.lit(None).cast("bigint")

    def units(body: Column, bracket: Column) -> Column:
        sign, whole, part = (F.regexp_extract(body, shape, k) for k in (1, 2, 3))
        fine = body.rlike(shape) & ((F.length(whole) > 0) | (F.length(part) > 0)) & ~(bracket & (F.length(sign) > 0))
        major = F.when(F.length(whole) > 0, whole).otherwise("0").try_cast("bigint")
        minor = F.rpad(F.coalesce(part, F.lit("")), 2, "0").try_cast("bigint")
        n = F.try_add(F.try_multiply(major, F.lit(100).cast("bigint")), minor)
        return F.when(fine, F.when(bracket | (sign == "-"), -n).otherwise(n))

    def of(t: Column) -> Column:
        bracket = t.rlike(r"^\(.*\)$")
        inner = F.trim(F.regexp_extract(t, r"^\((.*)\)$", 1))
        # A lambda's argument is worked out once, however often it is used.
        return F.get(F.transform(F.array(F.regexp_replace(F.when(bracket, inner).otherwise(t), ",", "")), lambda body: units(body, bracket)), F.lit(0))

    t = F.trim(text)
    # Plain amounts are the rule; only what has another form goes through the steps for it.
    digits = F.replace(t, F.lit("."), F.lit(""))
    plain = t.rlike(r"\A-?[0-9]{1,15}\.[0-9]{2}\z")
    return F.when(plain, digits.try_cast("bigint")).when(t.isNotNull(), of(t)).otherwise(null)


def strftime_to_spark(pattern: str) -> str:
    """A strftime date pattern as a Spark one; single letters also take unpadded numbers."""
    table = {"%Y": "yyyy", "%y": "yy", "%m": "M", "%d": "d", "%e": "d", "%b": "MMM", "%B": "MMMM", "%H": "H", "%M": "m", "%S": "s", "%j": "D", "%%": "%", "%F": "yyyy-M-d"}
    out, k = [], 0
    while k < len(pattern):
        pair = pattern[k : k + 2]
        if pair in table:
            out.append(table[pair])
            k += 2
        else:
            c = pattern[k]
            out.append(f"'{c}'" if c.isalpha() else c)
            k += 1
    return "".join(out)


def ageing_days(opened_at: Column, as_of: Column) -> Column:
    """Whole periods of 24 hours since ``opened_at``."""
    return F.floor((F.unix_micros(as_of) - F.unix_micros(opened_at)) / F.lit(86_400_000_000)).cast("bigint")


def ageing_bucket(days: Column) -> Column:
    return F.when(days <= 1, "0-1d").when(days <= 7, "2-7d").when(days <= 30, "8-30d").otherwise("30d+")


def ref_prefix(ref: Column) -> Column:
    """The first two pieces of a reference split at '-'."""
    return F.slice(F.split(ref, "-", -1), 1, 2)


def _known(c: Column) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def score_pair(a: str, b: str) -> Column:
    """How well row ``b`` of the other source fits row ``a``: 0 to 1, not symmetric.

    The terms are added from left to right, so that equal pairs give equal
    doubles in every engine.
    """
    x = lambda n: F.col(f"{a}.{n}")
    y = lambda n: F.col(f"{b}.{n}")
    gap = F.abs(x("amount_minor") - y("amount_minor")).cast("double")
    amount = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.0) - gap / F.greatest(x("amount_minor"), F.lit(1)).cast("double")))
    date = F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(F.datediff(x("value_date"), y("value_date"))).cast("double") / F.lit(float(DATE_SPAN)))
    ref = F.when(x("external_ref") == y("external_ref"), 1.0).otherwise(0.0)
    has = lambda v: _known(v("counterparty_bic")) | _known(v("counterparty_account"))
    same = (_known(x("counterparty_bic")) & F.coalesce(x("counterparty_bic") == y("counterparty_bic"), F.lit(False))) | (
        _known(x("counterparty_account")) & F.coalesce(x("counterparty_account") == y("counterparty_account"), F.lit(False))
    )
    w, v = WEIGHTS_3, WEIGHTS_4
    three = F.lit(w[0]) * amount + F.lit(w[1]) * date + F.lit(w[2]) * ref
    four = F.lit(v[0]) * amount + F.lit(v[1]) * date + F.lit(v[2]) * ref + F.lit(v[3]) * F.when(same, 1.0).otherwise(0.0)
    total = F.when(has(x) & has(y), four).otherwise(three)
    gate = (x("direction") == y("direction")) & (x("currency") == y("currency"))
    return F.when(gate, F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))).otherwise(0.0)


def amount_bound(threshold: float) -> float:
    """The largest relative amount gap that can still reach ``threshold``."""
    return max(1 - (threshold - (1 - w)) / w for w in (WEIGHTS_3[0], WEIGHTS_4[0]))


def rounded_percent(x: Column) -> Column:
    """A share as a percentage with one decimal, halves away from zero."""
    return F.round(x * 1000) / 10


def rationale(score: Column) -> Column:
    """A score as whole per cent, halves to even."""
    return F.concat(F.bround(score * 100, 0).cast("bigint").cast("string"), F.lit("%"))


#: Decimal places of the currencies that do not have two.
EXPONENTS = {**dict.fromkeys(("BIF", "CLP", "DJF", "GNF", "ISK", "JPY", "KMF", "KRW", "PYG", "RWF", "UGX", "VND", "VUV", "XAF", "XOF", "XPF"), 0), **dict.fromkeys(("BHD", "IQD", "JOD", "KWD", "LYD", "OMR", "TND"), 3)}


def exponent(currency: Column) -> Column:
    """Decimal places of a currency; two where nothing else is known."""
    places = F.lit(2)
    for n in (0, 3):
        places = F.when(currency.isin(*[c for c, e in EXPONENTS.items() if e == n]), n).otherwise(places)
    return places


def display_money(minor: Column, currency: Column) -> Column:
    """An amount for people, by the currency's own decimal places: "-EUR 1,234.50"; an em dash where amount or currency is missing."""
    unit = F.pow(F.lit(10), exponent(currency)).cast("bigint")
    size = F.abs(minor)
    whole = F.regexp_replace(F.call_function("div", size, unit).cast("string"), "(?<=[0-9])(?=([0-9]{3})+$)", ",")
    part = F.when(unit > 1, F.concat(F.lit("."), F.lpad((size % unit).cast("string"), exponent(currency), F.lit("0")))).otherwise("")
    return F.coalesce(F.concat(F.when(minor < 0, "-").otherwise(""), currency, F.lit(" "), whole, part), F.lit("\u2014"))
