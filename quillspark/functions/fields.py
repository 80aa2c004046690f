"""Fields of a receipt by ordered rules over its text, as Column expressions without Python in the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .amounts import first_amount, last, normalize_all, normalize_amount, numbers
from .rx import any_of, cut, first, first_found, flat, folded, full_lines, groups, has, holds, let, line_start, lines, low_rx, place, trim, unix, with_folded

FIELDS = ("amount", "subtotal", "tax", "pct", "date", "invoice_number", "vendor_name", "vendor_ids", "customer_name", "customer_ids", "payment_method", "currency", "items")
PARTIES = ("vendor_name", "vendor_ids", "customer_name", "customer_ids")

# A word that the text must hold, and a pattern, in the order in which they are tried.
TOTALS = [
    ("total a pagar", r"total\s+a\s+pagar\s*[:\-=]?\s*(?:bs\.?\s*)?([\d.,]+)"),
    ("total factura", r"\btotal\s+factura\s*[:\-=]?\s*(?:bs\.?\s*)?([\d.,]+)"),
    ("grand total", r"\bgrand\s+total\s*[:\-=]?\s*(?:bs\.?\s*)?([\d.,]+)"),
    ("amount due", r"\bamount\s+due\s*[:\-=]?\s*(?:[\$€£B\/\.]\s*)?([\d.,]+)"),
    ("total due", r"\btotal\s+due\s*[:\-=]?\s*(?:[\$€£B\/\.]\s*)?([\d.,]+)"),
    ("balance due", r"\bbalance\s+due\s*[:\-=]?\s*(?:[\$€£B\/\.]\s*)?([\d.,]+)"),
    ("importe total", r"\bimporte\s+total\s*[:\-=]?\s*(?:bs\.?\s*)?([\d.,]+)"),
    ("total a cobrar", r"\btotal\s+a\s+cobrar\s*[:\-=]?\s*(?:bs\.?\s*)?([\d.,]+)"),
    ("monto total", r"\bmonto\s+total\s*[:\-=]?\s*(?:bs\.?\s*)?(?:[\$€£B\/\.]\s*)?([\d.,]+)"),
    ("total general", r"\btotal\s+general\s*[:\-=]?\s*(?:bs\.?\s*)?(?:[\$€£B\/\.]\s*)?([\d.,]+)"),
    ("neto a pagar", r"\bneto\s+a\s+pagar\s*[:\-=]?\s*(?:bs\.?\s*)?(?:[\$€£B\/\.]\s*)?([\d.,]+)"),
    ("valor total", r"\bvalor\s+total\s*[:\-=]?\s*(?:bs\.?\s*)?(?:[\$€£B\/\.]\s*)?([\d.,]+)"),
    ("total venta", r"\btotal\s+venta\s*[:\-=]?\s*(?:bs\.?\s*)?(?:[\$€£B\/\.]\s*)?([\d.,]+)"),
    ("total pagado", r"\btotal\s+pagado\s*[:\-=]?\s*(?:bs\.?\s*)?(?:[\$€£B\/\.]\s*)?([\d.,]+)"),
    ("total", r"\btotal\s+(?:bs|usd|\$|b\/\.)\s*[:\-=]?\s*([\d.,]+)"),
    ("total", r"^\s*total\s*[:\-=]?\s*(?:bs\.?\s*)?(?:[\$€£B\/\.]\s*)?([\d.,]+)\s*$"),
    ("total", r"^total\s*$\s*([\d.,]+)"),
    ("total", r"\btotal\b(?!\s+(?:iva|igv|vat|tax|itbms|itbis|impuesto|impuestos|de\s|items?|productos?|l[ií]nea|por\s|neto|exento|gravado|base|imponible|parcial|abonado|anterior|del\s+mes|descuento))[^\d\n]{0,25}([\d.,]+)"),
]
SUBTOTALS = [
    ("sub", r"sub\s*total\s*[:\-=]?\s*(?:bs\.?\s*)?([\d.,]+)"),
    ("base imponible", r"\bbase\s+imponible\s*[:\-=]?\s*(?:bs\.?\s*)?([\d.,]+)"),
    ("net amount", r"\bnet\s+amount\s*[:\-=]?\s*(?:[\$€£]\s*)?([\d.,]+)"),
    ("taxable amount", r"\btaxable\s+amount\s*[:\-=]?\s*(?:[\$€£]\s*)?([\d.,]+)"),
    ("total neto", r"\btotal\s+neto\s*[:\|]?\s*([\d.,]+)"),
    ("sub", r"^\s*subt?l?[.\s]*[:\-=]?\s*(?:\$\s*)?([\d.,]+)"),
    ("subtotal", r"\bsubtotal\b[^\d\n]{0,25}([\d.,]+)"),
    ("neto", r"\bneto\s*[:\-=]?\s*(?:[\$€£]\s*)?([\d.,]+)"),
    ("valor total", r"\bvalor\s+total\s*[:\-=]?\s*(?:bs\.?\s*)?(?:[\$€£B\/\.]\s*)?([\d.,]+)"),
]
TAX_PLACE = r"(?=[ivt])(?<!\w)(?:iva|igv|itbms|itbis|vat|tax|impuesto)(?!\w)"  # any sales tax is a tax
EXEMPT = r"\b(exento|exempt|exclu[íi]do|excluido|libre\s+de\s+iva|sin\s+iva|no\s+sujeto)\b"
ZERO_TAX_WORDS = "exento|exempt|iva|igv|itbms|vat|impuesto"
ZERO_TAX = r"\b(exento|exempt|0\s*%\s*(?:iva|igv|itbms|vat)|iva\s*0[.,]?0*%?|itbms\s*0|sin\s+impuesto|libre\s+de\s+impuesto)\b"
SKIP_VENDOR = r"^(seniat|sentat|sen[il]at|providencia|administraci[oó]n\s+tributaria|servicio\s+nacional|ministerio|repúblic|gobierno|national\s+tax|iva\b|tax\s+auth|fecha\b|factura\b|invoice\b|recibo\b|receipt\b|tel[eé]f|fax|e-?mail|www\.|http|rif\b|ruc\b|nit\b|dv\b|comprobante\b|dgi\b|factura\s+de\s+operaci[oó]n|tipo\s+de\s+receptor|emisor\b|cliente\b|receptor\b|direcci[oó]n\b|punto\s+de\s+facturaci[oó]n|electr[oó]nica\b|nota\s+de\s+(?:cr[eé]dito|d[eé]bito)|ticket\b|boleta\b|original\b|copia\b)"
SKIP_TERMINAL = r"^(DC\d+|POS[\-\s]?\d*|TERM[\-\s]?\d+|CAJA\s*\d+|REG\s*\d+|TML\s*\d+|[A-Z]{1,3}\d{1,4})$"
NO_NAME = r"^[\d\s\-\/\\.,;:()+]+$"
LETTERS = r"[a-záéíóúñA-ZÁÉÍÓÚÑ]{3,}"
VENDOR_IDS = [
    ("rif", r"rif\s*[:\-]?\s*([jgve]-?\d[\d\-]+\d)"),
    ("ruc", r"ruc\s*[:\-]?\s*([a-z0-9\-\.]{6,20})"),
    ("nit", r"nit\s*[:\-]?\s*([\d\-\.]{6,20})"),
    ("cif", r"cif\s*[:\-]?\s*([a-z0-9\-\.]{6,20})"),
    ("cuit", r"cuit\s*[:\-]?\s*([\d\-\.]{8,20})"),
    ("ein", r"ein\s*[:\-]?\s*(\d{2}-\d{7})"),
    ("vat", r"vat\s*(?:id\s*)?[:\-]?\s*([a-z]{2}[a-z0-9]{6,18})"),
]
INVOICES = [
    ("factura|invoice", r"(?:factura|invoice)\s*(?:nro\.?|no\.?|n[uú]m\.?|n[°o]\.?|#)?\s*[:\-]?\s*([a-z0-9][a-z0-9\-\/]{3,19})"),
    ("mero|number", r"(?:n[uú]mero|number)\s+(?:de\s+)?(?:factura|comprobante|invoice)\s*[:\-]?\s*([a-z0-9][a-z0-9\-\/]{3,19})"),
    ("comprobante", r"comprobante\s*(?:nro\.?|no\.?|#)?\s*[:\-]?\s*([a-z0-9][a-z0-9\-\/]{3,19})"),
    ("mero", r"\bn[uú]mero\s*:\s*(\d{4,20})"),
]
NOT_INVOICE = r"^(fecha|date|serie|hora|fax|tel|rif|ruc|nit|cif|vat)"
ITEM = r"^(.+?)\s+(\d{1,4})\s+(?:[Bb][Ss]\.?\s*)?(?:[\$€£]\s*)?([\d.,]+)\s+(?:[Bb][Ss]\.?\s*)?(?:[\$€£]\s*)?([\d.,]+)\s*$"
NOT_ITEM = r"^(descripci[oó]n|cant|total|subtotal|iva|fecha|factura)"
CUSTOMER = r"(?=[CRADBS])(?:Cl[ií]ent[eo]?|Ciente|Ciento|(?<!Tipo de )Receptor|Comprador|Adquir(?:iente|ente)|Destinatario|Customer|Client|Bill(?:ed)?\s+To|Sold\s+To|Raz[oó]n\s*Social)\s*:"
VENDOR_LABEL = r"(?=[EPVISR])(?:Emisor|Proveedor|Vendedor|Issuer|Seller|Raz[oó]n\s*Social\s*(?:Emisor|del\s+Emisor)?|Empresa|Establecimiento)\s*:\s*(.+)"
VENDOR_ID_LABEL = r"(?=[RNCEV])(?:RUC|RFC|NIT|CUIT|RIF|CIF|EIN|VAT\s*(?:ID|No\.?)?)\s*[:\-]?\s*([\w\d\-\.]{5,25})"
CUSTOMER_ID_LABEL = r"(?=[RNCE])(?:RUC\/C[eé]dula\/Pasaporte|RUC\s+Cliente|RFC|NIT|CUIT|RIF|C\.?I\.?|EIN)\s*[:\-]?\s*([\w\d\-\.\/]{4,25})"
CUSTOMER_PLACE = low_rx(CUSTOMER.replace(r"\s", r"[^\S\n]"))  #: within a line of a flat text
_ID = r"([\w\d\-\.]+)"
LABELS = {
    "Emisor": r"Emisor\s*:\s*(.+)", "Proveedor": r"Proveedor\s*:\s*(.+)", "Vendedor": r"Vendedor\s*:\s*(.+)", "Issuer": r"Issuer\s*:\s*(.+)", "Seller": r"Seller\s*:\s*(.+)", "Razón Social": r"Raz[oó]n\s*Social\s*:\s*(.+)",
    "RUC": r"RUC\s*:\s*" + _ID, "RIF": r"RIF\s*[:\-]?\s*" + _ID, "RFC": r"RFC\s*:\s*" + _ID, "NIT": r"NIT\s*:\s*" + _ID, "CUIT": r"CUIT\s*:\s*" + _ID, "C.I.": r"\bC\.?I\.?\s*[:\-]?\s*([\d\-\.]{6,15})",
    "Cliente": r"Cl[ií]ent[eo]?\s*:\s*(.+)", "Ciento": r"\bCiento\s*:\s*(.+)", "Ciente": r"\bCiente\s*:\s*(.+)", "Receptor": r"Receptor\s*:\s*(.+)", "Comprador": r"Comprador\s*:\s*(.+)", "Customer": r"Customer\s*:\s*(.+)",
    "Bill To": r"Bill(?:ed)?\s+To\s*:\s*(.+)", "Sold To": r"Sold\s+To\s*:\s*(.+)", "Adquiriente": r"Adquir(?:iente|ente)\s*:\s*(.+)",
    "RUC_Cédula_Pasaporte": r"RUC\/C[eé]dula\/Pasaporte\s*:\s*([\w\d\-\.\/]+)", "RUC Cliente": r"RUC\s+Cliente\s*[:\-]?\s*([\w\d\-\.\/]+)", "NIT Cliente": r"NIT\s+Cliente\s*[:\-]?\s*([\w\d\-\.\/]+)",
    "Número": r"N[úu]mero\s*:\s*(\S+)", "Fecha de Emisión": r"Fecha de Emisi[óo]n\s*:\s*(\S+)", "Tipo de Receptor": r"Tipo de Receptor\s*:\s*(.+)", "Dirección": r"Direcci[oó]n\s*:\s*(.+)",
}
#: Words (between bars) that a text with the label holds when folded, where that isn't the label itself.
LABEL_WORDS = {
    "Razón Social": "social", "C.I.": "ci|c.i", "Cliente": "client|clíent", "Bill To": "bill", "Sold To": "sold to", "Adquiriente": "adquir", "RUC_Cédula_Pasaporte": "/pasaporte",
    "Número": "numero|número", "Fecha de Emisión": "fecha de emis", "Dirección": "direcci",
}
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
SHORT_MONTHS = ("ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic")
CURRENCIES = ("VES", "USD", "EUR", "COP", "MXN", "ARS", "CLP", "PAB", "PEN")
CURRENCY_MARKS = [
    ("VES", "bs|ves", r"\bBs\.?\s*[\d,.]|\bBs\b|\bVES\b", "i"), ("PAB", "itbms|b/.|pab|panam", r"\bITBMS\b|\bB\/\.|\bPAB\b|Panam[aá]", "i"), ("EUR", "€|eur", r"€|\bEUR\b", ""), ("USD", "usd|us$", r"\bUSD\b|\bUS\$\b", ""), ("MXN", "mxn|xico", r"\bMXN\b|M[eé]xico", "i"),
    ("COP", "cop|colombia", r"\bCOP\b|Colombia", "i"), ("ARS", "ars|argentina", r"\bARS\b|Argentina", "i"), ("CLP", "clp|chile", r"\bCLP\b|Chile\b", "i"), ("PEN", "pen|s/", r"\bPEN\b|S\/\.?\s?\d", "i"),
]


def total(text: Column) -> Column:
    return normalize_amount(let(flat(text), lambda low: first_amount(low, TOTALS)))


def subtotal(text: Column) -> Column:
    """By label; else a whole number right behind `subtotal`, as merged columns leave it."""
    return let(let(flat(text), lambda low: normalize_all(_subtotals(low, None))), lambda m: _either(m[0], m[1]))


def _subtotals(text: Column, low: Column | None) -> list[Column]:
    """text: the flat one."""
    return [first_amount(text, SUBTOTALS, low=low), first(text, low_rx(r"\bsubtotal\s*[:\-=€$£B\/\.]?\s*(\d+(?:[.,]\d+)?)"), flags="")]


def _either(labelled: Column, merged: Column) -> Column:
    return F.coalesce(labelled, F.when(merged > 0, merged))


def tax(text: Column) -> Column:
    """Of the first line with a tax word: 0 if it says exempt, else its last number that is no percentage."""
    return let(flat(unix(text)), _tax)


def _tax(text: Column) -> Column:
    """text: the flat one with unix lines."""
    value = lambda x: F.when(has(x, low_rx(EXEMPT), ""), F.lit(0.0)).otherwise(last(F.filter(numbers(x, True), lambda n: n >= 0)))
    line = lambda at: F.substring_index(F.substring(text, line_start(text, at), F.length(text)), "\n", 1)
    told = lambda x: F.when(has(x, TAX_PLACE, ""), value(x))
    # nearly always the first such line has a value; lines behind it are looked at where it has none
    return let(place(text, TAX_PLACE), lambda at: F.when(at > 0, F.coalesce(let(line(at), value), first_found(lines(text), told, "double"))))


def tax_percentage(text: Column) -> Column:
    return let(flat(text), _tax_percentage)


def _tax_percentage(text: Column) -> Column:
    """text: the flat one."""
    words = r"(?=[ivt])(?<!\w)(?:iva|igv|vat|tax|impuesto)(?!\w)"
    got = F.coalesce(first(text, words + r"[^%\d\n]{0,30}(\d{1,2}(?:[.,]\d{1,2})?)\s*%", flags=""), first(text, r"(?=\d)(\d{1,2}(?:[.,]\d{1,2})?)\s*%[^%\n]{0,20}" + words, flags=""))
    value = F.when(F.contains(text, F.lit("%")), F.replace(got, F.lit(","), F.lit("."))).try_cast("double")
    return let(value, lambda v: F.when((v > 0) & (v < 100), v))


def zero_tax_signal(text: Column, low: Column | None = None) -> Column:
    return with_folded(text, low, lambda low: holds(low, ZERO_TAX_WORDS) & has(text, ZERO_TAX))


def clean_ocr_field(s: Column) -> Column:
    """Cut at five spaces, then without trailing marks; a dot behind a capital letter stays."""
    out = trim(cut(trim(F.regexp_replace(s, r"\s{5,}.*", "")), r"[,;:]+$"))
    return let(out, lambda x: F.when(has(x, r"[A-Z]\.$", ""), x).otherwise(trim(cut(x, r"\.+$"))))


def clean_party_name(s: Column) -> Column:
    return let(clean_ocr_field(s), lambda c: F.when((F.length(c) >= 2) & ~has(c, r"^[.\-_/\s]+$"), c))


def clean_tax_id(s: Column) -> Column:
    return let(F.upper(cut(trim(s), r"[,;:.]+$")), lambda c: F.when(has(c, r"\d") & (F.length(c) >= 4), c))


def _company_line(x: Column) -> Column:
    return F.length(x).between(4, 80) & ~has(x, SKIP_VENDOR) & ~has(x, SKIP_TERMINAL) & ~has(x, NO_NAME) & x.rlike(LETTERS)


def vendor_name(text: Column, rows: Column | None = None) -> Column:
    """The first plausible company name among the ten top lines; rows: the text's full lines, if the caller has them."""
    address = lambda x: has(x, r"^\d+\s+\w{1,4}\.?\s") & (F.size(F.split(x, " ", -1)) <= 4)
    top = F.slice(full_lines(text) if rows is None else rows, 1, 10)
    plausible = first_found(top, lambda x: F.when(_company_line(x) & ~has(x, r"^\d{4}-\d{2}-\d{2}") & ~address(x), x))
    return trim(cut(plausible, r"[,;:.]+$"))


def vendor_ids(text: Column, low: Column | None = None, flat_text: Column | None = None) -> Column:
    use = lambda low, one: F.array(*(F.when(holds(low, word), trim(F.upper(first(one, low_rx(p), flags="")))) for word, p in VENDOR_IDS))
    return F.array_distinct(F.filter(_both(text, low, flat_text, use), lambda x: x.isNotNull()))


def _both(text: Column, low: Column | None, flat_text: Column | None, use) -> Column:
    """use(folded text, flat text), which are computed here, once, unless the caller has them."""
    return with_folded(text, low, lambda low: let(flat(text), lambda one: use(low, one)) if flat_text is None else use(low, flat_text))


def invoice_number(text: Column, low: Column | None = None, flat_text: Column | None = None) -> Column:
    """By the first label in order whose first match is one; later ones are not tried."""
    good = lambda x: x.isNotNull() & ~has(x, NOT_INVOICE) & ~has(x, r"^\d{4}[-\/]\d{2}[-\/]\d{2}$", "") & ~has(x, r"^[A-Z]{4,}$", "")
    found = lambda one, p: let(trim(F.upper(first(one, low_rx(p), flags=""))), lambda x: F.when(good(x), x))
    return _both(text, low, flat_text, lambda low, one: F.coalesce(*(F.when(holds(low, word), found(one, p)) for word, p in INVOICES)))


def payment_method(text: Column, low: Column | None = None) -> Column:
    says = lambda low, words, pattern: holds(low, words) & has(text, pattern)
    return with_folded(text, low, lambda low: F.when(says(low, "tarjeta|card", "tarjeta|card"), "CARD").when(says(low, "efectivo|cash", "efectivo|cash"), "CASH").when(says(low, "transfer|pago", r"transferencia|transfer|pago\s+m[oó]vil"), "TRANSFER"))


def items(text: Column, rows: Column | None = None) -> Column:
    """Lines `description quantity unit total`, as an array of structs; rows: the text's full lines, if the caller has them."""
    rows = F.filter(F.transform(F.filter(full_lines(text) if rows is None else rows, lambda x: F.contains(F.lit("0123456789.,"), F.right(x, F.lit(1))) & ~has(x, NOT_ITEM)), lambda x: groups(x, ITEM, 4, "")), lambda g: g.isNotNull())
    priced = F.transform(rows, lambda g: F.struct(g.alias("g"), normalize_all([g[2], g[3]]).alias("m")))
    made = F.transform(priced, lambda p: F.struct(trim(p["g"][0]).alias("description"), p["g"][1].cast("int").alias("quantity"), p["m"][0].alias("unit_price"), p["m"][1].alias("total")))
    return F.filter(made, lambda i: (i["unit_price"] != 0) & (i["total"] != 0) & (i["quantity"] >= 1))


def label_values(text: Column, labels, low: Column | None = None) -> Column:
    """Array of the values of some of LABELS, null where there is none; a label is looked for where the text holds a word that it needs."""
    value = lambda p: F.substring(trim(F.regexp_replace(trim(first(text, p)), r"\s{5,}.*", "")), 1, 120)
    found = lambda low: F.array(*(F.when(holds(low, LABEL_WORDS.get(k, k.lower())), value(LABELS[k])) for k in labels))
    return with_folded(text, low, lambda low: F.transform(found(low), lambda v: F.when(v != "", v)))


def labeled_fields(text: Column) -> Column:
    """Map of label to value, in the labels' order."""
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, LABELS)), label_values(text, LABELS)), lambda _, v: v.isNotNull())


def customer_split(text: Column) -> Column:
    """Text before the first line with a customer's label, and text from there on; null if there is none."""
    return let(let(flat(text), lambda low: _split(text, low)), lambda p: F.struct(p["before"].alias("before"), p["after"].alias("after")))


def _split(text: Column, low: Column) -> Column:
    """customer_split's parts, also of the flat text."""

    def cut_at(x: Column) -> Column:
        rows, low_rows, start = x["rows"], x["low"], x["start"]
        part = lambda whole, rows: (F.when(start == 0, whole).otherwise(F.substring(rows, F.lit(1), start - 2)), F.when(start > 0, F.substring(rows, start, F.length(rows))))
        (before, after), (low_before, low_after) = part(x["text"], rows), part(low_rows, low_rows)
        return F.struct(before.alias("before"), after.alias("after"), low_before.alias("low_before"), low_after.alias("low_after"))

    begin = lambda low: let(place(low, CUSTOMER_PLACE), lambda at: F.when(at > 0, line_start(low, at)).otherwise(0))
    made = lambda x: F.struct(x["text"].alias("text"), x["rows"].alias("rows"), x["low"].alias("low"), begin(x["low"]).alias("start"))
    return let(let(F.struct(text.alias("text"), unix(text).alias("rows"), unix(low).alias("low")), made), cut_at)


def labeled_parties(text: Column) -> Column:
    return let(flat(text), lambda low: let(_split(text, low), lambda p: _parties(text, low, p)))


def _parties(text: Column, low: Column, p: Column, only=PARTIES) -> Column:
    """low: the flat text; p: the parts by _split."""
    told = lambda x, pattern: first(x, low_rx(pattern), flags="")
    cased = lambda x, low, pattern: F.when(has(low, low_rx(pattern), ""), first(x, pattern))
    one = lambda x: F.filter(F.array(x), lambda v: v.isNotNull())
    customer = CUSTOMER + r"\s*(.+)"
    found = {
        "vendor_name": clean_party_name(cased(p["before"], p["low_before"], VENDOR_LABEL)),
        "vendor_ids": one(clean_tax_id(told(p["low_before"], VENDOR_ID_LABEL))),
        "customer_name": clean_party_name(F.when(p["after"].isNotNull(), first(p["after"], customer)).otherwise(cased(text, low, customer))),
        "customer_ids": one(clean_tax_id(told(p["low_after"], CUSTOMER_ID_LABEL))),
    }
    return F.struct(*(found[f].alias(f) for f in only))


def date(text: Column) -> Column:
    """YYYY-MM-DD of the first kind of date that occurs; days come before months, nothing is range-checked, and the
    abbreviation `may` is not known."""
    return let(flat(text), _date)


def _date(t: Column) -> Column:
    two = lambda x: F.lpad(x, 2, "0")

    def dated(pattern: str, year: int, month: int, day: int, month_of=two) -> Column:
        """The first match once, its parts from that match alone."""
        return let(first(t, pattern, 0, ""), lambda m: F.concat(first(m, pattern, year, ""), F.lit("-"), month_of(first(m, pattern, month, "")), F.lit("-"), two(first(m, pattern, day, ""))))

    def named(pattern: str, months: dict[str, str]) -> Column:
        table = F.create_map(*(F.lit(x) for kv in months.items() for x in kv))
        return dated(pattern, 3, 2, 1, lambda m: F.try_element_at(table, m))

    long = {m: f"{i:02}" for i, m in enumerate(MONTHS, 1)}
    short = {m: f"{i:02}" for i, m in enumerate(SHORT_MONTHS, 1) if m != "may"}
    return F.coalesce(
        F.when(F.contains(t, F.lit("fecha")), dated(r"fecha\s*:?\s*(\d{1,2})\s*[-/]\s*(\d{1,2})\s*[-/]\s*(\d{4})", 3, 2, 1)),
        dated(r"(?=\d)(?<!\w)(\d{4})[\/.-](\d{2})[\/.-](\d{2})(?!\w)", 1, 2, 3),
        dated(r"(?=\d)(?<!\w)(\d{1,2})[\/.-](\d{1,2})[\/.-](\d{4})(?!\w)", 3, 2, 1),
        F.when(F.contains(t, F.lit("de")), named(r"(?=\d)(?<!\w)(\d{1,2})\s+de\s+(" + "|".join(MONTHS) + r")\s+(?:de\s+)?(\d{4})(?!\w)", long)),
        named(r"(?=\d)(?<!\w)(\d{1,2})\s+(" + "|".join(SHORT_MONTHS) + r")\s+(\d{4})(?!\w)", short),
    )


def sanitize_currency(code: Column) -> Column:
    up = trim(F.upper(code))
    return F.when(up.isin(*CURRENCIES), up)


def currency(text: Column, hint: Column, low: Column | None = None) -> Column:
    """By marks in the text, in order; else the hint if it is a known code; else USD.  low: the folded text, if the caller has it."""

    def marked(low: Column) -> Column:
        out = F.when(text.isNull() | (text == ""), F.lit(None).cast("string"))
        for code, words, pattern, flags in CURRENCY_MARKS:
            out = out.when(holds(low, words) & has(text, pattern, flags), code)
        return F.when(low.rlike(any_of(sorted({w for _, words, _, _ in CURRENCY_MARKS for w in words.split("|")}))), out)

    return F.coalesce(with_folded(text, low, marked), sanitize_currency(hint), F.lit("USD"))


def rules(text: Column, only: tuple[str, ...] = FIELDS, low: Column | None = None) -> Column:
    """The generic rules over a text, as one struct; only: the fields that are read later, as within a struct the optimizer leaves none out.
    The folded and the flat text and the full lines are made once for all of them; low: the folded text, if the caller has it."""
    return let(F.struct((folded(text) if low is None else low).alias("low"), flat(unix(text)).alias("flat"), full_lines(text).alias("rows")), lambda shared: _rules(text, shared["low"], shared["flat"], shared["rows"], only))


def _rules(text: Column, low: Column, one: Column, rows: Column, only: tuple[str, ...]) -> Column:
    """one: the flat text with unix lines."""
    parties = [f for f in only if f in PARTIES]
    parts = {}
    if "amount" in only or "subtotal" in only:
        parts["m"] = normalize_all([first_amount(one, TOTALS, low=low), *(_subtotals(one, low) if "subtotal" in only else [])])
    if parties:
        parts["p"] = let(_split(text, one), lambda p: _parties(text, one, p, parties))
    if "tax" in only or "pct" in only:
        parts["t"] = _tax(one)
        parts |= {"pct": _tax_percentage(one)} if "pct" in only else {}
    shared = F.struct(*(c.alias(k) for k, c in parts.items())) if parts else F.lit(True)

    def made(x: Column) -> Column:
        exempt = lambda: x["t"].isNull() & zero_tax_signal(text, low)
        rule = {
            "amount": lambda: x["m"][0],
            "subtotal": lambda: _either(x["m"][1], x["m"][2]),
            "tax": lambda: F.when(exempt(), 0.0).otherwise(x["t"]),
            "pct": lambda: F.when(exempt(), 0.0).otherwise(x["pct"]),
            "date": lambda: _date(one),
            "invoice_number": lambda: invoice_number(text, low, one),
            "vendor_name": lambda: F.coalesce(x["p"]["vendor_name"], vendor_name(text, rows)),
            "vendor_ids": lambda: F.when(F.size(x["p"]["vendor_ids"]) > 0, x["p"]["vendor_ids"]).otherwise(vendor_ids(text, low, one)),
            "customer_name": lambda: x["p"]["customer_name"],
            "customer_ids": lambda: x["p"]["customer_ids"],
            "payment_method": lambda: payment_method(text, low),
            "currency": lambda: F.lit(None).cast("string"),
            "items": lambda: items(text, rows),
        }
        return F.struct(*(rule[f]().alias(f) for f in only))

    return let(shared, made)
