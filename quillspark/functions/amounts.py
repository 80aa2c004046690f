"""Amounts as people and tills write them: `1,234.56`, `1.234,56`, `Bs. 500`, `-3.20`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rx import cut, every, first, has, holds, let, low_rx, prefix_number, round2, trim, with_folded


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _without(text: Column, mark: str) -> Column:
    return F.replace(text, F.lit(mark), F.lit(""))


def normalize_amount(raw: Column) -> Column:
    """The value of an amount, null if there is none.  The last of two kinds of separators is the decimal one; a
    single separator is one for thousands if exactly three characters follow.  Amounts like 1,234.56 and 12.50 need no more than a look."""
    return let(raw, _amount)


def _amount(r: Column) -> Column:
    plain = r"^\d{1,3}(?:,\d{3})*\.\d{2}\z|^\d+\.\d{2}\z"
    return F.when(r.rlike(plain), _without(r, ",").cast("double")).otherwise(_any_amount(r))


def normalize_all(raws: list[Column]) -> Column:
    """An array of the values of several amounts, null where there is none.  The plan holds the rule once, not once for each."""
    return F.transform(F.array(*raws), lambda r: F.when(r.isNotNull(), _amount(r)))


def _any_amount(raw: Column) -> Column:
    clean = trim(F.regexp_replace(F.translate(F.when(F.contains(F.lower(raw), F.lit("bs")), cut(raw, r"\bBs\.?\s*")).otherwise(raw), "$€£¥", ""), r"\s+", " "))
    marked = lambda bare: F.struct(bare.alias("t"), _count(bare, ".").alias("dots"), _count(bare, ",").alias("commas"))
    value = let(let(F.translate(clean, "-−", ""), marked), lambda m: prefix_number(F.regexp_replace(_plain(m), "[^0-9.]", "")))
    minus = lambda s: s.startswith("-") | s.startswith("−") | (s.contains("-") & ~has(s, r"\d-\d"))
    return let(clean, lambda s: F.when(has(s, r"\d"), value * F.when(minus(s), -1.0).otherwise(1.0)))


def _plain(m: Column) -> Column:
    """An amount's text with a dot as decimal separator and no others; m: the text and its counts of dots and commas."""
    t, dots, commas = m["t"], m["dots"], m["commas"]
    comma_to_dot = lambda x: F.regexp_replace(x, "^([^,]*),", "$1.")
    after = lambda mark: F.length(t) - F.instr(t, mark)
    return (
        F.when((dots > 0) & (commas > 0), F.when(F.instr(F.reverse(t), ",") < F.instr(F.reverse(t), "."), comma_to_dot(_without(t, "."))).otherwise(_without(t, ",")))
        .when(commas == 1, F.when(after(",") == 3, _without(t, ",")).otherwise(comma_to_dot(t)))
        .when(commas > 1, _without(t, ","))
        .when((dots > 1) | (dots == 1) & (after(".") == 3), _without(t, "."))
        .otherwise(t)
    )


def reconstruct_split_amount(a: Column, b: Column) -> Column:
    """An amount torn over two cells: the number that ends a and the one that starts b."""
    return normalize_amount(F.concat(first(a, r"([\d.,]+)\s*$"), first(b, r"^\s*([\d.,]+)")))


def amount_in_text(text: Column) -> Column:
    """The first amount with Bs, else with $ € £, else a bare number with a separator; signs are not read."""
    return normalize_amount(F.coalesce(first(text, r"\bBs\.?\s*([\d.,]+)"), first(text, r"[$€£]\s*([\d.,]+)"), first(text, r"(\d+(?:[.,]\d+)+)")))


def venezuelan_amount(text: Column) -> Column:
    """Dots are for thousands, the first comma is the decimal separator, the sign counts."""
    s = F.regexp_replace(_without(F.regexp_replace(text, r"[^\d.,\-]", ""), "."), "^([^,]*),", "$1.")
    value = F.nullif(F.regexp_extract(s, r"^-?\d*\.?\d*", 0), F.lit("")).try_cast("double")
    return value


def numbers(line: Column, no_percent: bool = False) -> Column:
    """All numbers of a line as doubles, those before a % left out on request."""
    found = every(line, r"([\d.,]++)(?!\s*%)" if no_percent else r"([\d.,]+)")
    return F.filter(F.transform(found, _amount), lambda x: x.isNotNull())


def last(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def first_amount(text: Column, patterns: list[tuple[str, str]], low: Column | None = None) -> Column:
    """Of a flat text, as text: the first pattern in order whose first match is a positive amount with two decimals at least; later ones are not tried,
    nor are those whose word the text doesn't hold.

    A match is positive if it holds a digit other than 0, as every digit of a match counts."""
    fits = lambda r: F.when(r.rlike(r"[.,]\d{2}") & r.rlike("[1-9]"), r)
    return with_folded(text, low, lambda low: F.coalesce(*(F.when(holds(low, word), let(first(text, low_rx(p), flags="m"), fits)) for word, p in patterns)))


def percent_of(value: Column, pct: Column) -> Column:
    """A percentage of an amount to two decimals, halves up.  The product's own decimals decide (six of them), as dividing
    first leaves half a cent a little below or above where it is."""
    return F.floor(F.round(value * pct, 6) + 0.5) / 100


def compute_fields(f: dict[str, Column]) -> dict[str, Column]:
    """What amount a, subtotal s, tax t and percentage p say about each other; the first case that applies wins.
    Nothing that is there changes."""
    a, s, t, p = (f[k] for k in ("amount", "subtotal", "tax", "pct"))
    A, S, T, P = (x.isNotNull() for x in (a, s, t, p))
    rate = lambda tax, sub: round2(tax / F.nullif(sub, F.lit(0.0)) * 100)
    diff_t, diff_s, pct_t = round2(a - s), round2(a - t), percent_of(s, p)
    zero = F.lit(0.0)
    base = round2(a / (p / 100 + 1))
    none = F.lit(None).cast("double")
    pick = lambda *cases: _first_case([A & S & T, A & S, A & T, S & T, S & P, A & P], cases)
    ok_t, ok_s = (diff_t >= 0) & (diff_t < a), (diff_s > 0) & (diff_s < a)
    amount = pick(a, a, a, round2(s + t), round2(s + pct_t), a)
    subtotal = pick(s, s, F.when(ok_s, diff_s), s, s, F.when(p == 0, a).otherwise(base))
    tax = pick(t, F.when(ok_t, diff_t), t, t, pct_t, F.when(p == 0, zero).otherwise(round2(a - base)))
    three = F.when((F.abs(s + t - a) < 0.06) & (s > 0), rate(t, s))
    pct = pick(three, F.when(ok_t, F.when(diff_t == 0, zero).when(s > 0, rate(diff_t, s))), F.when(ok_s & (t > 0), rate(t, diff_s)), F.when(t == 0, zero).when(s > 0, rate(t, s)), none, none)
    return {"amount": F.coalesce(a, amount), "subtotal": F.coalesce(s, subtotal), "tax": F.coalesce(t, tax), "pct": F.coalesce(p, pct)}


def _first_case(conditions: list[Column], values: tuple[Column, ...]) -> Column:
    out = F.when(conditions[0], values[0])
    for c, v in zip(conditions[1:], values[1:], strict=True):
        out = out.when(c, v)
    return out


def reconcile(total: Column, sub: Column, tax: Column, pct: Column) -> dict[str, Column]:
    """Subtotal and tax of a known total; nulls without one."""
    from_pct, rest_tax, rest_sub = percent_of(sub, pct), round2(total - sub), round2(total - tax)
    known = total.isNotNull()
    s = F.when(known, F.when(sub.isNotNull(), sub).when(tax.isNotNull(), F.when(rest_sub > 0, rest_sub)))
    t = F.when(known, F.when(tax.isNotNull(), tax).when(sub.isNotNull(), F.when(pct.isNotNull(), from_pct).when(rest_tax >= 0, rest_tax)))
    return {"subtotal": s, "tax": t}
