"""Source and target views derived from the driver tables.

Each text is a query both engines run; ``{table}`` stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "src": """
        select o_orderkey as id, o_custkey as cust,
               case when o_orderkey % 7 = 0 then null else o_orderstatus end as status,
               case when o_orderkey % 13 = 0 then o_totalprice + 1 else o_totalprice end as price,
               o_orderdate as odate, o_orderpriority as src_only
        from {orders} where o_orderkey % 11 <> 0""",
    "tgt": """
        select o_orderkey as id, o_custkey as cust, o_orderstatus as status,
               o_totalprice as price, o_orderdate as odate, 'keep' as note
        from {orders} where o_orderkey % 5 <> 0""",
    "src_null": """
        select case when o_orderkey % 100 = 0 then null else o_orderkey end as k1,
               o_orderstatus as k2, max(o_totalprice) as v
        from {orders} where o_orderkey % 3 <> 0 group by 1, 2""",
    "tgt_null": """
        select case when o_orderkey % 100 = 1 then null else o_orderkey end as k1,
               o_orderstatus as k2, min(o_totalprice) as v
        from {orders} where o_orderkey % 4 <> 0 group by 1, 2""",
    "src_conv": """
        select conv_id, turn, role,
               case when turn % 2 = 0 then concat(text, '!') else text end as text
        from {conversations} where (conv_id + turn) % 6 <> 0""",
    "tgt_conv": """
        select conv_id, turn, role, text
        from {conversations} where (conv_id + turn) % 4 <> 0""",
    "src_segment": """
        select c_custkey as cust, c_mktsegment as status
        from {customer} where c_custkey % 3 <> 0""",
    "src_dirty": """
        select event_id as id,
               case when event_id % 17 = 0 then 'n/a' else cast(user_id as varchar(20)) end as user_txt,
               case when event_id % 23 = 0 then '' when event_id % 29 = 0 then 'n/a'
                    else substring(cast(ts as varchar(40)), 1, 10) end as day_txt,
               event_type as kind, value as dbl
        from {events}""",
    "pts": """
        select c_custkey as id,
               (c_custkey * 37) % 360 - 180 + 0.5e0 as x,
               (c_custkey * 53) % 160 - 80 + 0.25e0 as y,
               case when c_custkey % 3 = 0 then 0 else 4326 end as srid
        from {customer}""",
    "runs": """
        select event_id as id, ts as time_added,
               case event_type when 'error' then 'failed' when 'signup' then 'queued'
                               when 'view' then 'in_process' else 'finished' end as status,
               case when event_type in ('error','click','purchase')
                    then ts + interval '90' second end as time_finished
        from {events}""",
    "words": """
        select event_id as id,
               case event_id % 8 when 0 then ' Yes' when 1 then 'T' when 2 then '"1"' when 3 then 'no'
                                 when 4 then 'F ' when 5 then '0' when 6 then 'maybe' end as word
        from {events}""",
    "src_tags": """
        select p_partkey as id,
               case when p_partkey % 4 = 0 then concat(p_brand, ' "new" ', chr(92)) else p_brand end as brand,
               p_type as kind
        from {part} where p_partkey % 6 <> 0""",
    "tgt_tags": """
        select p_partkey as id, p_brand as brand, p_type as kind
        from {part} where p_partkey % 5 <> 0""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = set(re.findall(r"{(\w+)}", text))
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def sql_with(*names: str) -> str:
    """A WITH clause defining the named views over the bare tables."""
    defined = [f"{name} as ({re.sub(r'{(\w+)}', r'\1', VIEWS[name])})" for name in names]
    return "with " + ",\n".join(defined) + "\n"
