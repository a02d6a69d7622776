"""Text normalisers as Column expressions; null counts as empty unless said otherwise."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles, mail domains, address words, digraphs and address forms of the data this library serves.
TITLES = ("bapak", "bp", "ibu", "bu", "mr", "mrs", "ms", "dr", "drs", "dra", "h", "hj", "ir", "prof", "sdr", "sdri")
DOMAINS = {"gmail.co": "gmail.com", "gmail.con": "gmail.com", "gmial.com": "gmail.com", "gmai.com": "gmail.com", "hotmial.com": "hotmail.com", "yaho.com": "yahoo.com", "yahoo.co": "yahoo.com"}
ADDRESS_WORDS = {"jl": "jalan", "jln": "jalan", "gg": "gang", "kec": "kecamatan", "kel": "kelurahan", "kab": "kabupaten", "no": "nomor"}
DIGRAPHS = (("oe", "u"), ("dj", "j"), ("tj", "c"), ("nj", "ny"), ("sj", "sy"), ("ch", "h"), ("ph", "f"), ("th", "t"), ("kh", "h"), ("q", "k"), ("v", "f"), ("x", "ks"), ("z", "s"))
ADDRESS_FORMS = ((r"(?i)\b(?:jl|jln|jalan)\.?\s+", "Jl. "), (r"(?i)\b(?:no|nomor)\.?\s*(?=\d)", "No. "), (r"(?i)\brt\.?\s*(?=\d)", "RT "), (r"(?i)\brw\.?\s*(?=\d)", "RW "))


def _decomposed() -> tuple[dict[str, str], dict[str, str]]:
    """What compatibility decomposition leaves of a character in ASCII: one character, and several."""
    one, more = {}, {}
    for code in (*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)):
        left = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if left:
            (one if len(left) == 1 else more)[chr(code)] = left
    return one, more


_ONE, _MORE = _decomposed()
_WIDE = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in _MORE) + "]"


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def ascii_only(x: Column) -> Column:
    """Compatibility decomposition, and then ASCII alone."""
    known = F.str_to_map(F.lit("\x02".join(f"{c}\x01{t}" for c, t in _MORE.items())), F.lit("\x02"), F.lit("\x01"))
    spelt = F.when(x.rlike(_WIDE), F.array_join(F.transform(F.split(x, ""), lambda c: F.coalesce(F.try_element_at(known, c), c)), "")).otherwise(x)
    return F.when(x.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(spelt, "".join(_ONE), "".join(_ONE.values())), r"[^\x00-\x7F]", "")).otherwise(x)


def basic(x: Column) -> Column:
    return F.lower(stripped(F.regexp_replace(ascii_only(F.coalesce(x, F.lit(""))), r"\s+", " ")))


def _tokens(x: Column) -> Column:
    return F.regexp_extract_all(basic(x), F.lit("[a-z0-9]+"), 0)


def person_name(x: Column) -> Column:
    return F.regexp_replace(F.array_join(_tokens(x), " "), f"^(?:(?:{'|'.join(TITLES)})(?: |$))+", "")


def email(x: Column) -> Column:
    value = F.regexp_replace(basic(x), " ", "")
    parts = F.split(value, "@")
    domain = F.create_map(*[F.lit(v) for pair in DOMAINS.items() for v in pair])
    return F.when(F.size(parts) == 2, F.concat_ws("@", parts[0], F.coalesce(F.try_element_at(domain, F.try_element_at(parts, F.lit(2))), F.try_element_at(parts, F.lit(2))))).otherwise(value)


def address(x: Column) -> Column:
    known = F.create_map(*[F.lit(v) for pair in ADDRESS_WORDS.items() for v in pair])
    return F.array_join(F.transform(_tokens(x), lambda t: F.coalesce(F.try_element_at(known, t), t)), " ")


def identifier(x: Column) -> Column:
    return F.regexp_replace(basic(x), "[^a-z0-9]", "")


def phone(x: Column) -> Column:
    d = F.regexp_replace(F.coalesce(x, F.lit("")), "[^0-9]", "")
    d = F.when(d.startswith("620"), F.substring(d, 3, 1 << 20)).when(d.startswith("62"), F.concat(F.lit("0"), F.substring(d, 3, 1 << 20))).otherwise(d)
    return F.when(d.startswith("8") & (F.length(d) >= 9), F.concat(F.lit("0"), d)).otherwise(d)


_TIME = r"(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?"
_AT = "[ H:mm[:ss]]['T'H:mm[:ss]]"
#: Shapes of dates and how they are read, in order: ISO, day first, month first where the day can't be a month, month names, digits alone.
DATE_FORMS = (
    (rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}{_TIME}$", (f"yyyy-M-d{_AT}",)), (rf"^\d{{4}}/\d{{1,2}}/\d{{1,2}}{_TIME}$", (f"yyyy/M/d{_AT}",)),
    (rf"^\d{{1,2}}/\d{{1,2}}/\d{{4}}{_TIME}$", (f"d/M/yyyy{_AT}", f"M/d/yyyy{_AT}")), (rf"^\d{{1,2}}-\d{{1,2}}-\d{{4}}{_TIME}$", (f"d-M-yyyy{_AT}", f"M-d-yyyy{_AT}")),
    (rf"^\d{{1,2}}\.\d{{1,2}}\.\d{{4}}{_TIME}$", (f"d.M.yyyy{_AT}", f"M.d.yyyy{_AT}")), (r"^\d{1,2}[ -][A-Za-z]{3}[ -]\d{4}$", ("d MMM yyyy",)),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", ("d MMMM yyyy",)), (r"^[A-Za-z]{3} \d{1,2},? \d{4}$", ("MMM d[,] yyyy",)), (r"^[A-Za-z]{4,9} \d{1,2},? \d{4}$", ("MMMM d[,] yyyy",)),
    (r"^[12]\d{3}(?:0[1-9]|1[0-2])[0-3]\d$", ("yyyyMMdd",)),
)


def parsed_timestamp(x: Column) -> Column:
    """A date and its time of day: ISO first, then day-first forms; null if none fits."""
    v = stripped(x)
    # fractions of a second are left out
    t = F.regexp_replace(v, r"(:\d{2})\.\d{1,6}$", "$1")
    named = F.initcap(F.replace(t, F.lit("-"), F.lit(" ")))
    out = F.lit(None).cast("timestamp")
    for shape, forms in DATE_FORMS:
        text = named if "MMM" in forms[0] else t
        out = F.coalesce(out, F.when(v.rlike(shape), F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms])))
    return out


def parsed_date(x: Column) -> Column:
    return F.to_date(parsed_timestamp(x))


def date_text(x: Column) -> Column:
    return F.coalesce(F.date_format(parsed_date(x), "yyyy-MM-dd"), basic(x))


def phonetic(x: Column) -> Column:
    text = person_name(x)
    for a, b in DIGRAPHS:
        text = F.replace(text, F.lit(a), F.lit(b))
    coded = F.transform(F.filter(F.split(text, " "), lambda t: t != ""), lambda t: F.regexp_replace(F.concat(F.substring(t, 1, 1), F.regexp_replace(F.substring(t, 2, 1 << 20), "[aiueoy]", "")), r"(.)\1+", "$1"))
    return F.array_join(coded, " ")


def ngrams(x: Column, size: int) -> Column:
    """The first eight of a value's sorted distinct n-grams, blanks removed; a short value is its own."""
    v = F.regexp_replace(x, " ", "")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(v) - size + 1, F.lit(1))), lambda i: F.substr(v, i, F.lit(size)))
    return F.when(F.length(v) <= size, F.array(v)).otherwise(F.slice(F.array_sort(F.array_distinct(grams)), 1, 8))


def name_block(x: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(F.slice(F.filter(F.split(person_name(x), " "), lambda t: t != ""), 1, 2), lambda t: F.left(t, F.lit(3)))), "")


def collapsed(x: Column) -> Column:
    return stripped(F.regexp_replace(x, r"\s+", " "))


def title_case(x: Column) -> Column:
    words = F.filter(F.split(collapsed(x), " "), lambda t: t != "")
    return F.array_join(F.transform(words, lambda w: F.when((F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) <= 3), w).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1 << 20))))), " ")


def standard_address(x: Column) -> Column:
    text = collapsed(x)
    for pattern, form in ADDRESS_FORMS:
        text = F.regexp_replace(text, pattern, form)
    return title_case(text)


def signature(x: Column) -> Column:
    """One sign for each run of digits, capitals and small letters of ASCII; 80 characters at most."""
    for run, sign in (("[0-9]+", "9"), ("[A-Z]+", "A"), ("[a-z]+", "a")):
        x = F.regexp_replace(x, run, sign)
    return F.left(x, F.lit(80))


def shape(x: Column) -> Column:
    """An anchored pattern of a value: runs of digits, capitals, small letters and blanks with their lengths, other characters escaped."""
    run = lambda r, form: F.concat(F.lit(form + "{"), F.length(r).cast("string"), F.lit("}"))
    one = lambda r: (
        F.when(r.rlike(r"^\p{Nd}"), run(r, r"\d")).when(r.rlike(r"^\p{Lu}"), run(r, "[A-Z]")).when(r.rlike(r"^\p{Ll}"), run(r, "[a-z]")).when(r.rlike(r"^\s"), run(r, r"\s"))
        .when(r.rlike(r"^\p{L}"), run(r, "[a-z]")).when(r.rlike(r"[()\[\]{}?*+\-|^$\\.&~#]"), F.concat(F.lit("\\"), r)).otherwise(r)
    )
    return F.concat(F.lit("^"), F.array_join(F.transform(F.regexp_extract_all(x, F.lit(r"(?s)(\p{Nd}+|\p{Lu}+|\p{Ll}+|\s+|.)"), 1), one), ""), F.lit("$"))


def number(x: Column, comma: bool = True) -> Column:
    """A double, a decimal comma allowed where ``comma`` is; null if the text isn't a number."""
    v = F.replace(stripped(x), F.lit(","), F.lit(".")) if comma else stripped(x)
    return F.when(v.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), v.try_cast("double"))


def masked(x: Column, strategy: str, keep_start: int = 4, keep_end: int = 2) -> Column:
    """``partial``, ``email_mask`` or ``hash``; null stays null."""
    n = F.length(x)
    if strategy == "partial":
        inner = F.concat(F.left(x, F.lit(keep_start)), F.repeat(F.lit("*"), F.greatest(n - keep_start - keep_end, F.lit(0))), F.right(x, F.lit(keep_end)))
        return F.when(n > keep_start + keep_end, inner).otherwise(F.repeat(F.lit("*"), n))
    if strategy == "email_mask":
        at = F.instr(x, "@")
        shown = F.least(at - 1, F.lit(2))
        return F.when(at > 0, F.concat(F.left(x, shown), F.repeat(F.lit("*"), F.greatest(at - 1 - shown, F.lit(1))), F.substring(x, at, F.lit(1 << 20)))).otherwise(F.repeat(F.lit("*"), n))
    if strategy == "hash":
        return F.substring(F.sha2(x, 256), 1, 12)
    raise ValueError(f"unknown masking strategy: {strategy}")


NORMALIZERS = {"basic": basic, "name": person_name, "phone": phone, "email": email, "address": address, "identifier": identifier, "date": date_text}


def normalized(x: Column, normalizers: list[str] | None, method: str = "") -> Column:
    for name in normalizers or [method if method in ("phone", "email") else "basic"]:
        x = NORMALIZERS[name](x)
    return x
