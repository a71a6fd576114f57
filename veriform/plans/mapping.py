"""Queries for projection, header mapping and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriform.operators import assignment as asg
from veriform.operators import mapping as mp
from veriform.plans import stand_ins as si
from veriform.plans.registry import query, table
from veriform.sinks import lines as ln
from veriform.sources import records as rc

TARGET_SQL = """select "Invoice ID" as "InvoiceID", "Customer ID" as "CustomerID", "Customer Name" as "CustomerName", "Invoice Date" as "InvoiceDate",
  "Due Date" as "DueDate", "Total Amount" as "TotalAmount", "Payment Status" as "PaymentStatus" """


def invoices(spark, sf):
    staged = si.staged_invoices(spark, sf)
    return mp.project_to_target(staged, mp.mapping_for(staged, si.TARGET, si.SYNONYMS), si.TARGET)


@query("invoice_projection", f"{TARGET_SQL} from ({si.STAGED_SQL})")
def invoice_projection(spark, sf):
    return invoices(spark, sf)


@query("header_mapping", f"with {si.MATCH_CTE} select doc_id, target, header, cast(position as integer) as position, cast(score as integer) as score from matched")
def header_mapping(spark, sf):
    matched = mp.match_frame(si.header_files(spark, sf), "headers", si.TARGET, si.SYNONYMS)
    return mp.matches_long(matched, ["doc_id"])


# Headers that several targets want: none, one or two letters apart, repeated, and words of the text among them.
NEAR_TARGETS = ("LineTotalNet", "LineTotalNets", "LineTotals", "OrderDates", "OrderDate", "Region", "Remark")
NEAR_SYNONYMS = {"Area": "Region", "Note": "Remark"}
NEAR_LINE = f"""case doc_id % 5
  when 0 then concat('LineTotalNet,LineTotalNet,OrderDate,Area,', {si.TEXT_NAMES})
  when 1 then concat({si.TEXT_NAMES}, ',LineTotlNets,LineTotals,Line Total,Orderdate,order date,Region,Area,Note')
  when 2 then concat('LineTotalNtes,LineTotalNets,LineTotalNet,OrderDats,Remark,Note,', {si.TEXT_NAMES})
  when 3 then concat('OrderDate,OrderDat,LineTotalNet,', {si.TEXT_NAMES}, ',LineTotalNett,LineTotal Nets')
  else concat({si.TEXT_NAMES}, ',LineTotal,', {si.TEXT_NAMES}, ',LineTotal,OrderDates,OrderDates') end"""

# Every way to give headers to targets, one target after another; of its headers a target needs no more than there are targets.
NEAR_SQL = f"""with recursive {si.scored_cte(NEAR_TARGETS, NEAR_SYNONYMS, NEAR_LINE)},
few as (select * from (select *, row_number() over (partition by doc_id, idx order by score, position) as r from scored where score is not null) where r <= {len(NEAR_TARGETS)}),
offers as (select doc_id, idx, cast(position as integer) as position, cast(score as integer) as score from few union all select doc_id, idx, null, null from lines, targets),
ways as (select doc_id, -1 as idx, cast([] as integer[]) as places, 0 as lost, 0 as cost from lines
  union all select w.doc_id, w.idx + 1, list_append(places, coalesce(o.position, 1000000000)), lost + case when o.position is null then 1 else 0 end, cost + coalesce(o.score, 0)
  from ways w join offers o on o.doc_id = w.doc_id and o.idx = w.idx + 1 and (o.position is null or not list_contains(places, o.position))),
best as (select doc_id, places from (select *, row_number() over (partition by doc_id order by lost, cost, places) as r from ways where idx = {len(NEAR_TARGETS) - 1}) where r = 1)
select doc_id, target, header, cast(position as integer) as position, cast(score as integer) as score from best join scored using (doc_id) where score is not null and places[idx + 1] = position"""


@query("header_assignment", NEAR_SQL)
def header_assignment(spark, sf):
    files = si.documents_with(spark, sf, "header_line", NEAR_LINE).select("doc_id", F.split("header_line", ",").alias("headers"))
    return mp.matches_long(asg.assign_headers(files, "headers", NEAR_TARGETS, NEAR_SYNONYMS), ["doc_id"])


@query("prefix_columns", "select r_regionkey as src_r_regionkey, r_name as src_r_name from region")
def prefix_columns(spark, sf):
    return mp.prefix_columns(table(spark, sf, "region"), "src_")


STATUS = "case when o_orderkey % 10 = 0 then null else o_orderstatus end"


@query("exclude_status", f"select o_orderkey, o_orderstatus from (select o_orderkey, {STATUS} as o_orderstatus from orders) where o_orderstatus is distinct from 'P'")
def exclude_status(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.expr(STATUS).alias("o_orderstatus"))
    return mp.exclude_equal(orders, "o_orderstatus", "P")


@query("filter_in", "select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus in ('F', 'O')")
def filter_in(spark, sf):
    return mp.keep_in(table(spark, sf, "orders"), "o_orderstatus", ["F", "O"]).select("o_orderkey", "o_orderstatus", "o_totalprice")


MISSING_NAME = "case when o_orderkey % 11 = 0 then ' n/a' when o_orderkey % 11 = 1 then '' else c_name end"


@query(
    "drop_missing",
    f"""select o_orderkey, customer from (select o_orderkey, {MISSING_NAME} as customer from orders left join customer on o_custkey = c_custkey and c_custkey % 4 <> 0)
where customer is not null and upper(trim(customer)) not in ('', 'NULL', 'N/A')""",
)
def drop_missing(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").filter(F.col("c_custkey") % 4 != 0)
    joined = o.join(c, o["o_custkey"] == c["c_custkey"], "left").select("o_orderkey", F.expr(MISSING_NAME).alias("customer"))
    return mp.drop_missing(joined, "customer")


@query("filter_dates", "select o_orderkey, o_totalprice from orders where cast(o_orderdate as date) between date '1996-02-01' and date '1996-12-31'")
def filter_dates(spark, sf):
    return mp.between_dates(table(spark, sf, "orders"), "o_orderdate", "1996-02-01", "1996-12-31").select("o_orderkey", "o_totalprice")


@query("filter_last_days", "select o_orderkey, o_totalprice from orders where cast(o_orderdate as date) between date '2001-08-01' - interval 30 day and date '2001-08-01'")
def filter_last_days(spark, sf):
    return mp.last_days(table(spark, sf, "orders"), "o_orderdate", 30, "2001-08-01").select("o_orderkey", "o_totalprice")


PRODUCT_XML = """concat('<Product SKU="', p_brand, '-', p_partkey, '" DepartmentCode="', p_type, '"><ProductName>', p_name,
  '</ProductName><Brand>', p_brand, '</Brand><ProductStatus>', case when p_size < 5 then 'Low Stock' else 'Active' end,
  '</ProductStatus><InventoryDetails><QuantityOnHand>', p_size, '</QuantityOnHand></InventoryDetails><PricingInfo><RetailPrice currency="USD">',
  cast(p_retailprice as decimal(18,2)), '</RetailPrice></PricingInfo>', case when p_partkey % 3 = 0 then '<Tag>a</Tag><Tag>b</Tag>' else '' end, '</Product>')"""
PRODUCT_SCHEMA = (
    "_SKU string, _DepartmentCode string, ProductName string, Brand string, ProductStatus string, "
    "InventoryDetails struct<QuantityOnHand: bigint>, PricingInfo struct<RetailPrice: struct<_VALUE: decimal(18,2), _currency: string>>, Tag array<string>"
)


def products(spark, sf):
    xml = table(spark, sf, "part").select("p_partkey", F.expr(PRODUCT_XML).alias("xml"))
    return xml.select("p_partkey", rc.from_xml_record(F.col("xml"), PRODUCT_SCHEMA).alias("p"))


@query(
    "scan_xml",
    "select p_partkey, concat(p_brand, '-', p_partkey) as sku, p_type as department, p_name as product_name, cast(p_size as bigint) as quantity, 'USD' as currency from part",
)
def scan_xml(spark, sf):
    return products(spark, sf).select(
        "p_partkey", F.col("p._SKU").alias("sku"), F.col("p._DepartmentCode").alias("department"),
        F.col("p.ProductName").alias("product_name"), F.col("p.InventoryDetails.QuantityOnHand").alias("quantity"),
        F.col("p.PricingInfo.RetailPrice._currency").alias("currency"),
    )


@query(
    "xml_inventory",
    """select concat(p_brand, '-', p_partkey) as "SKU", p_name as "ProductName", p_brand as "Brand", cast(p_size as bigint) as "QuantityOnHand",
  case when p_size < 5 then 'Low Stock' else 'Active' end as "Status", cast(p_retailprice as decimal(18,2)) as "RetailPrice", tag as "Tag"
from part left join (values (0, 'a'), (0, 'b')) t(m, tag) on p_partkey % 3 = m""",
)
def xml_inventory(spark, sf):
    return mp.explode_then_flatten(products(spark, sf), "p.Tag", {
        "SKU": "p._SKU", "ProductName": "p.ProductName", "Brand": "p.Brand", "QuantityOnHand": "p.InventoryDetails.QuantityOnHand",
        "Status": "p.ProductStatus", "RetailPrice": "p.PricingInfo.RetailPrice._VALUE", "Tag": "item",
    })


@query("column_subset", "select o_orderkey, o_custkey, o_orderdate from orders")
def column_subset(spark, sf):
    return mp.subset(table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderdate"])


@query("empty_input", "select 'o_orderkey|o_custkey|o_totalprice' as line union all select concat_ws('|', o_orderkey, o_custkey, o_totalprice) from orders where o_totalprice < 0")
def empty_input(spark, sf):
    none = table(spark, sf, "orders").filter(F.col("o_totalprice") < 0)
    return ln.to_pipe_lines(none, ["o_orderkey", "o_custkey", "o_totalprice"])
