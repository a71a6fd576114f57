"""The flagship: invoices verified, converted to lines, validated, with a status for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriform.functions.values import escape_field, iso_date, split_escaped
from veriform.operators import attempts as at
from veriform.operators import checks as ck
from veriform.operators import reconcile as rec
from veriform.operators import voting as vt
from veriform.plans import stand_ins as si
from veriform.plans.registry import query
from veriform.plans.sinks import escaped

SEP = "|"
FIELDS = [f"f{i}" for i in range(len(si.TARGET))]


def target_fields(spark, sf):
    """Staged invoices in the target layout as text, with some values missing or in another layout."""
    k = F.col("Row Key")
    day = F.when(k % 31 == 0, F.lit("soon")).when(k % 7 == 0, F.date_format(F.col("Invoice Date").cast("date"), "MM/dd/yyyy")).otherwise(F.col("Invoice Date"))
    staged = si.staged_invoices(spark, sf).select(
        k.alias("k"), F.col("Invoice ID").alias("f0"), F.col("Customer ID").alias("f1"), F.when(k % 17 != 0, F.col("Customer Name")).alias("f2"),
        iso_date(day).alias("f3"), F.col("Due Date").alias("f4"), F.col("Total Amount").cast("string").alias("f5"), F.col("Payment Status").alias("f6"),
    )
    return staged.withColumns({f"t{i}": F.coalesce(F.trim(F.col(f)), F.lit("")) for i, f in enumerate(FIELDS)})


def verifiers():
    present = ck.mandatory({t: F.col(f) for t, f in zip(si.TARGET, FIELDS, strict=True)})
    typed = ck.check(F.col("f3").isNotNull() & F.col("f5").isNotNull(), "Unreadable date or amount")
    return [vt.vote_of(present), vt.vote_of(typed), vt.vote_of(ck.no_injection(F.coalesce("f2", F.lit(""))))]


def texts():
    return [F.col(f"t{i}") for i in range(len(FIELDS))]


def convert(i: int, notes):
    """First a plain join of the fields; once rejected, with escapes. Some answers are damaged."""
    fields = texts() if i == 0 else [escape_field(t, SEP) for t in texts()]
    # A null is left out by concat_ws, and the line is then a field short.
    last = F.when(F.col("k") % 41 != 0, fields[-1])
    return F.when(F.col("k") % 43 != 0, F.concat(F.lit("<output>"), F.concat_ws(SEP, *fields[:-1], last), F.lit("</output>")))


def validators(line):
    layout = rec.layout_check(line, si.TARGET, SEP)
    same = ck.check(split_escaped(line, SEP) == F.array(*texts()), "Values differ")
    dated = ck.check(F.get(split_escaped(line, SEP), 3).rlike(r"^\d{4}-\d{2}-\d{2}$"), "Date not YYYY-MM-DD")
    return [vt.vote_of(layout), vt.vote_of(same), vt.vote_of(dated)]


def converted(spark, sf):
    return at.run_documents(target_fields(spark, sf), "f0", verifiers(), convert, validators)


LINE = "concat_ws('|', " + ", ".join(escaped(f"coalesce(trim({f}), '')") for f in FIELDS) + ")"


@query(
    "convert_invoices",
    f"""select f0 as "InvoiceID", case when status = 'success' then {LINE} end as line, status, case status when 'failed' then 3 when 'conversion_error' then 0 when 'success' then tries end as retries
from (select *, case when f3 is null then 'pre-verification_failed' when k % 43 = 0 then 'conversion_error' when k % 41 = 0 then 'failed' else 'success' end as status,
  case when contains(coalesce(f2, ''), '|') then 1 else 0 end as tries
from (select "Row Key" as k, "Invoice ID" as f0, "Customer ID" as f1, case when "Row Key" % 17 <> 0 then "Customer Name" end as f2, case when "Row Key" % 31 <> 0 then "Invoice Date" end as f3,
  "Due Date" as f4, cast("Total Amount" as varchar) as f5, "Payment Status" as f6 from ({si.STAGED_SQL})))""",
)
def convert_invoices(spark, sf):
    return converted(spark, sf).select(F.col("f0").alias("InvoiceID"), F.col("output").alias("line"), "status", "retries")
