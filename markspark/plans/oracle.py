"""DuckDB SQL for the adapters, used to build the oracle of every query.

Each entry is the SQL twin of a function in :mod:`markspark.plans.adapters`
or of a shared step in :mod:`markspark.plans.catalog`. ``with_(...)``
assembles a WITH clause from the named pieces.
"""

from __future__ import annotations

CTE: dict[str, str] = {}

CTE["cases"] = """
select o_orderkey as serial_no, cast(o_orderdate as date) as filing_dt,
  case when o_orderstatus in ('F', 'P') then cast(o_orderdate as date) + cast(o_orderkey % 60 as integer) end as publication_dt,
  case when o_orderstatus = 'F' then cast(o_orderdate as date) + cast(o_orderkey % 60 + 90 as integer) end as registration_dt,
  'Mark ' || cast(o_custkey as varchar) || '-' || cast(o_orderkey % 5 as varchar) as mark_id_char,
  cast(o_orderpriority = '1-URGENT' as integer) as acq_dist_in,
  cast(o_orderpriority = '2-HIGH' as integer) as acq_dist_part_in,
  cast(o_orderpriority = '5-LOW' and o_orderstatus = 'P' as integer) as supp_reg_in
from orders"""

CTE["oa"] = """
select l_orderkey as serial_no, cast(count_if(l_returnflag = 'R') as bigint) as descriptive_sum,
  cast(count_if(l_discount >= 0.09::double) as bigint) as generic_sum
from lineitem group by l_orderkey"""

CTE["designs"] = "select l_orderkey as serial_no from lineitem where l_quantity >= 49.0::double"

CTE["clean"] = """
select * from cases c
where mark_id_char is not null and not exists (select 1 from designs d where d.serial_no = c.serial_no)
qualify row_number() over (partition by mark_id_char
  order by (filing_dt is null) desc, filing_dt desc, serial_no desc) = 1"""

CTE["labelled"] = """
select x.*, case when coalesce(not coalesce(supp_reg_in = 1, false) and (
    (pub_ind = 1 and acq_dist_in = 0) or
    (pub_ind = 0 and generic_sum = 0 and descriptive_sum = 0 and supp_reg_in = 0)), false)
  then 1 else 0 end as distinct_ind
from (select c.*, cast(c.publication_dt is not null as integer) as pub_ind, oa.descriptive_sum, oa.generic_sum
      from clean c left join oa using (serial_no)) x"""

CTE["classes"] = """
select o_orderkey as serial_no,
  case o_orderpriority when '1-URGENT' then '9' when '2-HIGH' then '16' when '3-MEDIUM' then '25'
    when '4-NOT SPECIFIED' then 'A' when '5-LOW' then '200' end as intl_class_cd
from orders
union all
select o_orderkey as serial_no, 'B' as intl_class_cd from orders where o_orderstatus = 'O'"""

CTE["single_class"] = """
select * from classes where serial_no in (
  select serial_no from classes group by serial_no having count(intl_class_cd) = 1)"""

CTE["class_int"] = """
select serial_no, try_cast(intl_class_cd as integer) as intl_class_cd from single_class
where (intl_class_cd not in ('A', 'B', '200') or intl_class_cd is null)
  and try_cast(intl_class_cd as integer) is not null"""

CTE["statements"] = """
select conv_id as serial_no, turn as seq, role as statement_type_cd, text as statement_text from conversations"""

CTE["stmt_concat"] = """
select serial_no, string_agg(statement_text, ' ' order by seq) as statement_text from statements group by serial_no"""

CTE["nice"] = """
select n_nationkey + 1 as Class, n_name || ', Goods & Services!' as Description from nation"""

CTE["lexicon"] = """
select distinct token from (select unnest(regexp_split_to_array(lower(text), '\\s+')) as token from benchmark) t
where token <> ''"""

CTE["translations"] = """
select o_orderkey as serial_no, cast(o_orderdate as date) as filing_dt,
  case o_orderkey % 3 when 0 then '-1' when 1 then 'mark ' || cast(o_custkey as varchar) || ' '
    else 'Marque ' || cast(o_custkey as varchar) end as mark_translated
from orders"""

CTE["scored"] = """
select l_orderkey, l_partkey, l_suppkey, l_linenumber,
  cast(l_returnflag in ('R', 'A') and l_quantity >= 20.0::double as integer) as label,
  logit_0, logit_1, prob, cast(logit_1 > logit_0 as integer) as pred, l_returnflag, l_linestatus, l_shipdate
from (select *, round(-0.8::double * logit_1 + l_tax, 6) as logit_0,
             round(1.0::double / (1.0::double + exp(-logit_1)), 6) as prob
      from (select *, round((l_quantity - 25.5::double) / 12.5::double + 10.0::double * (l_discount - 0.05::double), 6) as logit_1
            from lineitem) a) b"""

CTE["court"] = """
select p_partkey as row_id, p_name as mark, p_brand as description, p_size as nice_class,
  case p_type when 'ECONOMY' then 'generic' when 'LARGE' then 'descriptive' when 'MEDIUM' then 'suggesitve'
    when 'PROMO' then 'arbitrary' when 'SMALL' then 'fanciful' when 'STANDARD' then 'other' end as court_text,
  case when p_type in ('ECONOMY', 'LARGE') then 0 else 1 end as distinct_ind,
  prob as model_probs, cast(prob >= 0.5::double as integer) as model_preds
from (select *, round(1.0::double / (1.0::double + exp(-((p_retailprice - 1400.0::double) / 300.0::double
        + (p_size - 25.0::double) / 20.0::double))), 6) as prob from part) p"""

CTE["delays"] = """
select s.l_orderkey, s.l_partkey, s.l_suppkey, s.l_linenumber, cast(o.o_orderdate as date) as filing_dt,
  cast(s.l_shipdate as date) as publication_dt, s.prob, s.label,
  cast(datediff('day', cast(o.o_orderdate as date), cast(s.l_shipdate as date)) as integer) as delay
from scored s join orders o on s.l_orderkey = o.o_orderkey"""


def with_(names: list[str], body: str) -> str:
    """``WITH name AS (...), ... body`` for the listed pieces, in order."""
    parts = ",\n".join(f"{n} AS ({CTE[n]})" for n in names)
    return f"WITH {parts}\n{body}"


# dependency closure helpers for the common chains
CASE_CHAIN = ["cases", "oa", "designs", "clean", "labelled"]
CLASS_CHAIN = ["classes", "single_class", "class_int"]
