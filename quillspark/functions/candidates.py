"""Array-valued candidates of a receipt: totals with roles, subtotals, taxes, names, ids and table rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .amounts import last, numbers
from .fields import LABELS, LETTERS, NO_NAME, SKIP_TERMINAL, SKIP_VENDOR, clean_ocr_field, clean_tax_id, label_values, labeled_fields  # noqa: F401
from .rx import cut, every, first, folded, full_lines, groups, has, holds, let, rx, trim

# Words that mark a line, also as text recognition garbles them, and the roles of labels in order.
TOTAL_TOKEN = r"\b([T7][O0Q][T7][A4@][L1I]|sub\s*[T7][O0Q][T7][A4@][L1I]|sub\s*[T7][T7][L1I]|subt\.?|[T7][T7][L1I]|[T7][O0Q][T7]\b|[Il1][Mm][Pp][Oo0][Rr][T7][Ee3]|[Mm][Oo0][Nn][T7][Oo0]|[Nn][Ee3][T7][Oo0]|amount|balance)\b"
TAX_TOKEN = r"\b([Il1|]V[A4@]|[Il1|]GV|vat|tax|[Il1][T7][BbDd][Mm][S5$]|[Il1][T7][BbDd][Il1][S5$]|impue[s5]to|[s5]ale[s5]\s+tax)\b"
ROLES = [
    ("tax", r"\b(total\s+(?:iva|igv|vat|tax|itbms|impuesto)|total\s+impuestos?|total\s+itbms|impuesto\s+total|tax\s+total)\b"),
    ("line", r"\b(valor\s+item|item\s+total|total\s+l[ií]nea|por\s+l[ií]nea|line\s+total)\b"),
    ("final", r"\b(total\s+a\s+pagar|total\s+factura|total\s+general|total\s+pagado|total\s+a\s+cobrar|total\s+venta|monto\s+total|importe\s+total|grand\s+total|amount\s+due|total\s+due|balance\s+due|neto\s+a\s+pagar|gran\s+total)\b"),
    ("subtotal", r"\b(sub\s*total|subtotal|sub\s*ttl|subt\.|total\s+neto|base\s+imponible|net\s+amount|taxable\s+amount|valor\s+total)\b"),
]
_TYPE = r"Tipo de Receptor|Datos del (?:Cliente|Receptor|Comprador)|Receptor\s*:"
# both begin with a look at the first letter, as most places of a text fail there
CUSTOMER_BLOCK = rf"(?=[TDRCBS])(?={_TYPE}|Cl[ií]ent[eo]?\s*:|Bill(?:ed)?\s*To\s*:|Sold\s*To\s*:)"
ID_BLOCK = rf"(?=[TDRACBS])(?={_TYPE}|Adquir(?:iente|ente)\s*:|Comprador\s*:|Bill(?:ed)?\s*To\s*:|Sold\s*To\s*:|Cl[ií]ent[eo]?\s*:|Ciento\s*:|Ciente\s*:)"
ID_LABEL = r"(RUC\/C[eé]dula\/Pasaporte|RUC\s+Cliente|RUC|RFC|NIT\s+Cliente|NIT|CUIT|RIF|CIF|EIN|VAT\s*(?:ID|No\.?)?|C\.?I\.?)\s*[:\-]?\s*([\w\d\-\.\/]{4,25})"
VENDOR_KEYS = ("Emisor", "Proveedor", "Vendedor", "Issuer", "Seller")
CUSTOMER_KEYS = ("Cliente", "Ciento", "Ciente", "Receptor", "Comprador", "Customer", "Bill To", "Sold To", "Adquiriente")


def _lines_with(text: Column, pattern: str, values) -> Column:
    """(label, value) of the lines that match and hold a number; the value is the last one; equal lines count once."""
    rows = F.transform(F.filter(full_lines(text), lambda x: has(x, pattern)), lambda x: F.struct(x.alias("label"), last(values(x)).alias("value")))
    rows = F.filter(rows, lambda r: r["value"].isNotNull())

    def first_of_each(found: Column) -> Column:
        return let(F.transform(found, lambda r: F.lower(r["label"])), lambda keys: F.filter(found, lambda r, i: F.array_position(keys, F.lower(r["label"])) == i + 1))

    return let(rows, first_of_each)


def _positive(x: Column) -> Column:
    return F.filter(numbers(x), lambda n: n > 0)


def total_candidates(text: Column) -> Column:
    def role(label: Column) -> Column:
        out = F.when(has(label, ROLES[0][1]), ROLES[0][0])
        for name, pattern in ROLES[1:]:
            out = out.when(has(label, pattern), name)
        return out.otherwise("ambiguous")

    return F.transform(_lines_with(text, TOTAL_TOKEN, _positive), lambda r: F.struct(r["label"].alias("label"), r["value"].alias("value"), role(r["label"]).alias("role")))


def subtotal_candidates(text: Column) -> Column:
    return _lines_with(text, dict(ROLES)["subtotal"], _positive)


def tax_candidates(text: Column) -> Column:
    return _lines_with(text, TAX_TOKEN, lambda x: F.filter(numbers(x, True), lambda n: n >= 0))


def vendor_candidates(text: Column) -> Column:
    """Labelled names, then plausible top lines until there are eight."""
    named = F.array_distinct(F.filter(label_values(text, VENDOR_KEYS), lambda x: x.isNotNull()))
    plausible = lambda x: F.length(x).between(4, 80) & ~has(x, SKIP_VENDOR) & ~has(x, SKIP_TERMINAL) & ~has(x, NO_NAME) & x.rlike(LETTERS)
    top = F.transform(F.filter(F.slice(full_lines(text), 1, 10), plausible), clean_ocr_field)
    return F.slice(F.array_distinct(F.concat(named, top)), 1, 8)


def _sections(text: Column, boundary: str, use) -> Column:
    """use(text before the first mark, the rest), with the text split once."""
    rest = lambda parts: F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), "\n")
    return let(let(F.split(text, rx(boundary), -1), lambda parts: F.struct(F.get(parts, 0).alias("before"), rest(parts).alias("after"))), lambda s: use(s["before"], s["after"]))


def customer_candidates(text: Column) -> Column:
    social = lambda _, after: F.nullif(clean_ocr_field(first(after, LABELS["Razón Social"])), F.lit(""))
    told = lambda low: F.concat(label_values(text, CUSTOMER_KEYS, low), F.array(F.when(holds(low, "social"), _sections(text, CUSTOMER_BLOCK, social))))
    return F.array_distinct(F.filter(let(folded(text), told), lambda x: x.isNotNull()))


def classified_ids(text: Column) -> Column:
    """(value, section, label) of every labelled id; sections are split at the first customer's mark."""

    def scan(part: Column, section: str) -> Column:
        made = F.transform(every(part, ID_LABEL, 0), lambda m: F.struct(clean_tax_id(first(m, ID_LABEL, 2)).alias("value"), F.lit(section).alias("section"), trim(first(m, ID_LABEL, 1)).alias("label")))
        return F.filter(made, lambda p: p["value"].isNotNull())

    return _sections(text, ID_BLOCK, lambda before, after: F.concat(scan(before, "vendor"), scan(after, "customer")))


def table_rows(rows: Column) -> Column:
    """(label, value) of `label: value` lines, else of lines with four spaces between."""
    colon, gap = r"^([^:]{2,40})\s*:\s*(.+)$", r"^(.{2,40})\s{4,}(.+)$"
    pick = lambda x, g: F.coalesce(first(x, colon, g, ""), first(x, gap, g, ""))
    # each pattern takes a whole line or nothing, so one match gives both parts; a line feed within a line, as a word box may hold one, would look like their border
    both = lambda x: F.coalesce(F.when(F.contains(x, F.lit(":")), groups(x, colon, 2, "")), F.when(x.rlike(r"\s{4}"), groups(x, gap, 2, "")))
    told = lambda x: F.when(~F.contains(x, F.lit("\n")), both(x)).when(has(x, colon, "") | has(x, gap, ""), F.array(pick(x, 1), pick(x, 2)))
    found = F.filter(F.transform(rows, told), lambda g: g.isNotNull())
    return F.transform(found, lambda g: F.struct(trim(g[0]).alias("label"), trim(g[1]).alias("value")))


def identifications(text: Column) -> Column:
    """(type, value, role) by a scan over the lines: the first tax id before a customer's block is the vendor's."""
    rows = F.transform(F.split(text, "[\n\r]", -1), trim)
    start = F.struct(F.lit(False).alias("customer"), F.lit(False).alias("seen"), F.expr("cast(array() as array<struct<type:string,value:string,role:string>>)").alias("out"))

    def rif(raw: Column) -> Column:
        p = r"([JGVEP])-?(\d{7,9})(?:-?(\d))?"
        check = first(raw, p, 3)
        return F.concat_ws("-", F.upper(first(raw, p, 1)), first(raw, p, 2), check)

    def step(acc: Column, line: Column) -> Column:
        low = F.lower(line)
        block = acc["customer"] | has(line, r"rif\s*\/?\s*c\.?\s*i\.?\s*:?") | has(line, "cliente") | has(line, r"facturado\s*a")
        tax_id = F.coalesce(first(line, r"RIF\s*:?\s*([JGVEP]-?\d{7,9}(?:-\d)?)"), first(line, r"^([JGVEP]-?\d{7,9}(?:-\d)?)$"))
        ci = first(line, r"(?:C\.?\s*I\.?\s*:?\s*|RIF\s*\/\s*C\.?\s*I\.?\s*:?\s*)([VE]-?\d{6,10})")
        nit, ruc = first(low, r"nit\s*:?\s*([\d.]{6,15}(?:-\d)?)", 1, ""), first(low, r"ruc\s*:?\s*(\d{1,3}(?:-\d{3,8}(?:-\d{1,2})?)?|\d{6,12})", 1, "")
        rif_role = F.when(~acc["seen"] & ~block, "vendor").otherwise("customer")
        seen_nit = acc["seen"] | nit.isNotNull()
        role = lambda seen: F.when(~seen, "vendor").otherwise("customer")
        entry = lambda kind, value, who: F.when(value.isNotNull(), F.struct(F.lit(kind).alias("type"), value.alias("value"), who.alias("role")))
        ci_value = F.concat(F.upper(first(ci, r"([VE])-?(\d{6,10})", 1)), F.lit("-"), first(ci, r"([VE])-?(\d{6,10})", 2))
        found = (
            F.when(tax_id.isNotNull(), F.array(entry("RIF", rif(tax_id), rif_role)))
            .when(ci.isNotNull(), F.array(entry("CI", ci_value, F.lit("customer"))))
            .otherwise(F.array(entry("NIT", F.replace(nit, F.lit("."), F.lit("")), role(acc["seen"])), entry("RUC", F.upper(ruc), role(seen_nit))))
        )
        vendor = F.exists(found, lambda e: e.isNotNull() & (e["role"] == "vendor"))
        return F.struct(block.alias("customer"), (acc["seen"] | F.coalesce(vendor, F.lit(False))).alias("seen"), F.concat(acc["out"], F.filter(found, lambda e: e.isNotNull())).alias("out"))

    return F.aggregate(rows, start, step, lambda acc: acc["out"])


def strip_column_noise(s: Column) -> Column:
    """Cut at four spaces; short tokens that end in : or - go."""
    return F.nullif(trim(cut(trim(F.regexp_replace(s, r"\s{4,}.*", "")), r"(\s+\b\w{1,3}[:\-])+$", flags="")), F.lit(""))


def useful_content(text: Column) -> Column:
    """Whether an embedded text is worth reading: three lines, digits and letters."""
    return (F.size(F.filter(full_lines(text), lambda x: F.length(x) > 3)) >= 3) & text.rlike(r"\d{2}") & has(text, "[a-záéíóúñ]{3}")


def old_currency(text: Column, hint: Column) -> Column:
    """An older order of currency marks, with pounds and without a check of the hint."""
    # Currency, pattern, flags.
    marks = [("EUR", r"€|\bEUR\b", ""), ("GBP", "£", ""), ("VES", r"\bBs\.?\s*\d|\bBs\b|\bVES\b|\bVEF\b|bol[ií]var|SENIAT", "i"), ("USD", r"\bUSD\b|\bUS\$\b", ""), ("MXN", r"\bMXN\b|M[ée]xico", "i"), ("COP", r"\bCOP\b|Colombia", "i"), ("PEN", r"\bPEN\b|S\/\.?\s?\d", "i"), ("ARS", r"\bARS\b", "i"), ("CLP", r"\bCLP\b", "i"), ("PAB", r"\bPAB\b", "i")]
    out = F.when(text.isNull() | (text == ""), F.coalesce(hint, F.lit("USD")))
    for code, pattern, flags in marks:
        out = out.when(has(text, pattern, flags), code)
    return out.otherwise(F.coalesce(hint, F.lit("USD")))
