"""Personal data: detection by content and name, masking, standard forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions import text as tx
from sievelight.operators.profile import inferred_types
from sievelight.operators.rules import as_text

#: What a value must look like, and what is removed from it first; the share of values that must; hints and labels.
CONTENT = {"phone": (r"[\s\-()]", r"^(\+?62|0)8[0-9]{7,11}\z"), "email": ("", r"^[^@\s]+@[^@\s]+\.[^@\s]+\z"), "nik": ("[^0-9]", r"^[0-9]{16}\z")}
SHARE = 0.6
ROLES = {"name": ("nama", "name"), "phone": ("hp", "phone", "telp", "telepon", "handphone", "msisdn"), "email": ("email", "mail"), "address": ("alamat", "address", "addr"), "updated": ("update", "updated", "modified", "last_modified"), "source": ("sumber", "source", "asal_data")}
BY_NAME = {"nik": ("nik", "ktp"), "name": ("nama", "name"), "address": ("alamat", "address", "addr")}
LABELS = {"nik": "NIK", "phone": "Nomor HP", "email": "Email", "name": "Nama", "address": "Alamat"}


def roles(columns: list[str]) -> dict[str, str]:
    """The first column whose name speaks for each role."""
    return {role: found[0] for role, hints in ROLES.items() if (found := [c for c in columns if any(h in c.lower() for h in hints)])}


def role_of(columns: list[str]) -> dict[str, str]:
    """Each column's role; of several the last one."""
    return {column: role for role, column in roles(columns).items()}


def detect(df: DataFrame, columns: list[str] | None = None, order: str | None = None, first: int = 200) -> DataFrame:
    """column, pii_type, pii_label, strategy and a masked sample of columns that hold personal data.

    Phone, mail, identity number, name and address are tried in this order: by
    role, by the share of values that look like one (separators aside), or by
    name. All values are judged, or, where ``order`` names the row number, the
    ``first`` that aren't null. A column without values holds nothing.
    """
    columns = columns or [c for c in df.columns if c != order]
    own = role_of(columns)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), as_text(df, c).alias("v")) for i, c in enumerate(columns)]))
    rows = df.select(*([F.col(order).alias("at")] if order else []), cells.alias("c")).select("c.*", *(["at"] if order else [])).filter("v IS NOT NULL")
    if order:
        rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("i").orderBy("at"))).filter(F.col("k") <= first)
    sample = F.min_by("v", "at") if order else F.min("v")
    shares = {k: F.avg((F.regexp_replace("v", gone, "") if gone else F.col("v")).rlike(p).cast("int")) for k, (gone, p) in CONTENT.items()}
    sums = rows.groupBy("i").agg(sample.alias("sample"), *[e.alias(k) for k, e in shares.items()])
    hints = [(i, c, [k for k in LABELS if own.get(c) == k or any(h in c.lower() for h in BY_NAME.get(k, ()))]) for i, c in enumerate(columns)]
    named = df.sparkSession.createDataFrame(hints, "i int, column string, hints array<string>")
    kind = F.when(F.lit(False), F.lit(""))
    for k in ("phone", "email", "nik", "name", "address"):
        kind = kind.when(F.array_contains("hints", k) | (F.col(k) > SHARE if k in CONTENT else F.lit(False)), k)
    found = sums.join(F.broadcast(named), "i").withColumn("pii_type", kind).filter("pii_type IS NOT NULL")
    by_type = lambda make: F.coalesce(*[F.when(F.col("pii_type") == k, make(k)) for k in LABELS])
    return found.orderBy("i").select("column", "pii_type", by_type(lambda k: F.lit(LABELS[k])).alias("pii_label"), by_type(lambda k: F.lit(strategy(k))).alias("strategy"), by_type(lambda k: tx.masked(F.col("sample"), strategy(k))).alias("sample_masked"))


def strategy(pii_type: str) -> str:
    return "partial" if pii_type in ("nik", "phone") else "email_mask" if pii_type == "email" else "hash"


def mask(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``df`` with the columns of ``kinds`` (column to personal-data type) masked; missing columns are ignored."""
    return df.withColumns({c: tx.masked(as_text(df, c), strategy(k)) for c, k in kinds.items() if c in df.columns})


#: The standard form of each kind, and the name that reports give it (fixed values).
FORMS = {
    "phone": lambda v: F.when(tx.phone(v) != "", tx.phone(v)).otherwise(v), "email": lambda v: F.lower(tx.collapsed(v)), "name": tx.title_case,
    "address": tx.standard_address, "date": lambda v: F.coalesce(F.date_format(tx.parsed_date(v), "yyyy-MM-dd"), v), "text": tx.collapsed,
}
KINDS = {"phone": "nomor_hp", "email": "email", "name": "nama", "address": "alamat", "date": "tanggal_iso", "text": "teks"}


def standard_forms(df: DataFrame, columns: list[str] | None = None) -> dict[str, str]:
    """The form of each text column: by its role, else date where its values read as dates, else text."""
    texts = [c for c, t in df.dtypes if t == "string" and c in (columns or df.columns)]
    own = role_of(df.columns)
    forms = {c: own[c] for c in texts if own.get(c) in FORMS}
    rest = [c for c in texts if c not in forms]
    kinds = {r["column"]: r["inferred_type"] for r in inferred_types(df, rest).collect()} if rest else {}
    return {c: forms.get(c) or ("date" if kinds[c] == "date" else "text") for c in texts}


def standardize(df: DataFrame, forms: dict[str, str] | None = None) -> DataFrame:
    """``df`` with columns in standard form; ``forms`` names phone, email, name, address, date or text, and is found out where it isn't given.

    Doubles that are all whole become long; null stays null.
    """
    found = standard_forms(df) if forms is None else forms
    out = df.withColumns({c: F.when(F.col(c).isNotNull(), FORMS[k](as_text(df, c))) for c, k in found.items()})
    doubles = [c for c, t in df.dtypes if t in ("double", "float")] if forms is None else []
    if doubles:
        whole = df.agg(*[(F.coalesce(F.bool_and(F.col(c) == F.floor(c)), F.lit(False))).alias(c) for c in doubles]).first()
        out = out.withColumns({c: F.col(c).cast("long") for c in doubles if whole[c]})
    return out


def changes(before: DataFrame, forms: dict[str, str] | None = None, order: str | None = None, most: int = 5) -> DataFrame:
    """column, kind, the number of values that ``standardize`` changes and, where ``order`` names the row number, the first ``most`` of them."""
    forms = standard_forms(before, [c for c in before.columns if c != order]) if forms is None else forms
    cells = [F.struct(F.lit(c).alias("column"), F.lit(KINDS[k] if order else k).alias("kind"), as_text(before, c).alias("before"), FORMS[k](as_text(before, c)).alias("after")) for c, k in forms.items()]
    rows = before.select(*([F.col(order).alias("row")] if order else []), F.explode(F.array(*cells)).alias("c")).select("c.*", *(["row"] if order else [])).filter("before IS NOT NULL AND before <> after")
    counts = rows.groupBy("column", "kind").agg(F.count(F.lit(1)).alias("changed"))
    if not order:
        return counts
    firsts = rows.withColumn("k", F.row_number().over(Window.partitionBy("column").orderBy("row"))).filter(F.col("k") <= most)
    samples = firsts.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("row", "before", "after"))).alias("samples"))
    return counts.join(samples, "column")
