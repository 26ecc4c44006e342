"""The registered queries in plain SQL, written independently of the library."""

from __future__ import annotations

from catalogue.fixtures import sql_with

DIFFER = """(t.cust is distinct from s.cust or t.status is distinct from s.status
             or t.price is distinct from s.price or t.odate is distinct from s.odate)"""

CLASSIFIED = f"""
    select coalesce(s.id, t.id) as id, t.note,
           case when t.id is null then 'insert' when s.id is null then 'delete'
                when {DIFFER} then 'update' else 'same' end as op,
           t.cust as old_cust, s.cust as new_cust, t.status as old_status, s.status as new_status,
           t.price as old_price, s.price as new_price, t.odate as old_odate, s.odate as new_odate
    from tgt t full outer join src s on t.id = s.id"""

RESULT_FULL = """
    select s.id, s.cust, s.status, s.price, s.odate, t.note
    from src s left join tgt t on t.id = s.id"""

RESULT_NO_DELETE = RESULT_FULL + """
    union all
    select t.id, t.cust, t.status, t.price, t.odate, t.note
    from tgt t where not exists (select 1 from src s where s.id = t.id)"""

FILTERED = "src_only in ('1-URGENT', '2-HIGH') and price > 50000"

RESULT_FILTERED = f"""
    select s.id, s.cust, s.status, s.price, s.odate, t.note
    from src s left join tgt t on t.id = s.id where {FILTERED.replace('price', 's.price')}
    union all
    select t.id, t.cust, t.status, t.price, t.odate, t.note
    from tgt t where not exists (select 1 from src s where s.id = t.id and {FILTERED.replace('price', 's.price')})"""

NOT_REMOVED = """
    select id, cust, status, price, odate from src
    where not coalesce((status = 'F' and cust = 10) or status is null, false)"""

CONV_DIFFER = "t.text is distinct from s.text or t.role is distinct from s.role"

GOOD_DIRTY = """
    select id, try_cast(user_txt as bigint) as user_txt, try_cast(nullif(day_txt, '') as date) as day_txt, kind, dbl
    from src_dirty
    where user_txt <> 'n/a' and day_txt <> 'n/a'"""

# Whether SQL's NOT IN is true, spelled out: no other key may be possibly equal.
MAYBE_EQUAL = "(s.k1 = t.k1) is distinct from false and (s.k2 = t.k2) is distinct from false"

ORACLE: dict[str, str] = {
    "sync_classify_counts": sql_with("src", "tgt")
    + f"select op, count(*) as n from ({CLASSIFIED}) group by op",
    "sync_change_feed": sql_with("src", "tgt")
    + f"""select id, op, old_cust, new_cust, old_status, new_status, old_price, new_price, old_odate, new_odate
          from ({CLASSIFIED}) where op <> 'same'""",
    "sync_updated_rows": sql_with("src", "tgt")
    + f"""select t.id, s.cust, s.status, s.price, s.odate, t.note
          from tgt t join src s on t.id = s.id where {DIFFER}""",
    "sync_insert_missing": sql_with("src", "tgt")
    + "select id, cust, status, price, odate from src where id not in (select id from tgt)",
    "sync_delete_removed": sql_with("src", "tgt")
    + "select * from tgt where id not in (select id from src)",
    "sync_result_full": sql_with("src", "tgt") + RESULT_FULL,
    "sync_result_no_delete": sql_with("src", "tgt") + RESULT_NO_DELETE,
    "sync_result_filtered": sql_with("src", "tgt") + RESULT_FILTERED,
    "sync_keep_target_only_columns": sql_with("src", "tgt")
    + f"select op, note, count(*) as n from ({CLASSIFIED}) group by op, note",
    "sync_key_override": sql_with("src_segment", "tgt")
    + """select t.id, t.cust, case when s.cust is null then t.status else s.status end as status,
                t.price, t.odate, t.note,
                case when s.cust is null then 'delete'
                     when t.status is distinct from s.status then 'update' else 'same' end as op
         from tgt t left join src_segment s on t.cust = s.cust
         union all
         select null, s.cust, s.status, null, null, null, 'insert'
         from src_segment s where s.cust not in (select cust from tgt)""",
    "sync_composite_key": sql_with("src_conv", "tgt_conv")
    + f"""select case when t.conv_id is null then 'insert' when s.conv_id is null then 'delete'
                      when {CONV_DIFFER} then 'update' else 'same' end as op, count(*) as n
          from tgt_conv t full outer join src_conv s on t.conv_id = s.conv_id and t.turn = s.turn group by 1""",
    "sync_null_safe_keys": sql_with("src_null", "tgt_null")
    + """, s as (select *, true as here from src_null), t as (select *, true as there from tgt_null)
         select coalesce(t.k1, s.k1) as k1, coalesce(t.k2, s.k2) as k2, coalesce(s.v, t.v) as v,
                case when there is null then 'insert' when here is null then 'delete'
                     when t.v is distinct from s.v then 'update' else 'same' end as op
         from t full outer join s on t.k1 is not distinct from s.k1 and t.k2 is not distinct from s.k2""",
    "sync_not_in_keys": sql_with("src_null", "tgt_null")
    + f"""select t.k1, t.k2, coalesce(s.v, t.v) as v,
                 case when s.v is not null then case when t.v is distinct from s.v then 'update' else 'same' end
                      when exists (select 1 from src_null s where {MAYBE_EQUAL}) then 'same'
                      else 'delete' end as op
          from tgt_null t left join src_null s
            on t.k1 is not distinct from s.k1 and t.k2 is not distinct from s.k2
          union all
          select s.k1, s.k2, s.v, 'insert' from src_null s
          where not exists (select 1 from tgt_null t where {MAYBE_EQUAL})""",
    "sync_not_in_single_key": sql_with("src_null", "tgt_null")
    + "select * from src_null where k1 not in (select k1 from tgt_null where k1 is not null)",
    "sync_not_in_null_trap": sql_with("src_null", "tgt_null")
    + "select * from src_null where k1 not in (select k1 from tgt_null)",
    "sync_duplicate_keys": """
        select l_orderkey, l_linenumber, count(*) as n from lineitem
        group by l_orderkey, l_linenumber having count(*) > 1""",
    "sync_latest_per_key": """
        select event_id, ts, user_id, event_type, value, props from (
            select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events)
        where rn = 1""",
    "sync_idempotent": sql_with("src") + "select 'same' as op, count(*) as n from src",
    "sync_apply_changes": sql_with("src", "tgt") + RESULT_FULL,
    "sync_labels_of_documents": """
        select case when l.doc_id is null then 'insert' when d.doc_id is null then 'delete'
                    when l.quality is distinct from d.n_chars % 2 then 'update' else 'same' end as op,
               count(*) as n
        from labels l full outer join documents d on l.doc_id = d.doc_id group by 1""",
    "list_columns": sql_with("src_tags", "tgt_tags")
    + """, j as (
             select coalesce(t.id, s.id) as id, coalesce(s.brand, t.brand) as brand, coalesce(s.kind, t.kind) as kind,
                    case when t.id is null then 'insert' when s.id is null then 'delete'
                         when t.brand <> s.brand or t.kind <> s.kind then 'update' else 'same' end as op
             from tgt_tags t full outer join src_tags s on t.id = s.id)
         select op, id, concat('{"', replace(replace(brand, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'),
                               '","', replace(replace(kind, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'),
                               '"}') as tags_text
         from j""",
    "cast_valid_rows": sql_with("src_dirty") + GOOD_DIRTY,
    "cast_quarantine": sql_with("src_dirty")
    + """select id, 'user_txt' as column_name, user_txt as value from src_dirty where user_txt = 'n/a'
         union all select id, 'day_txt', day_txt from src_dirty where day_txt = 'n/a'""",
    "cast_empty_temporal": sql_with("src_dirty")
    + """select id, try_cast(nullif(day_txt, '') as date) as day, day_txt = 'n/a' as bad from src_dirty""",
    "cast_year_month_day": """
        select o_orderkey, cast(o_orderdate as date) as day,
               case when o_orderkey % 3 = 2 then date_trunc('second', o_orderdate)
                    else cast(cast(o_orderdate as date) as timestamp) end as stamp
        from orders""",
    "cast_varchar_limit": """
        select c_custkey, c_mktsegment as value from customer where length(c_mktsegment) > 9""",
    "cast_round_half_even": """
        select l_quantity / 2 as half, cast(round_even(l_quantity / 2, 0) as integer) as rounded, count(*) as n
        from lineitem group by 1, 2""",
    "cast_numbers_to_text": """
        select cast(l_orderkey as varchar) as l_orderkey,
               regexp_replace(cast(l_extendedprice as varchar), '\\.0$', '') as l_extendedprice,
               regexp_replace(cast(l_quantity as varchar), '\\.0$', '') as l_quantity,
               cast(l_shipdate as date) as l_shipdate
        from lineitem""",
    "cast_real_scale": """
        select cast(round(l_extendedprice / 4, 0) as bigint) as p, count(*) as n from lineitem group by 1""",
    "cast_bool_words": sql_with("words")
    + """select id, case when lower(trim(word, ' "')) in ('true', 'yes', '1', 'y', 't') then true
                         when lower(trim(word, ' "')) in ('false', 'no', '0', 'n', 'f') then false end as flag
         from words""",
    "filter_compare_between_in": """
        select l_orderkey, l_linenumber, l_quantity, l_discount, l_tax from lineitem
        where l_quantity >= 10 and l_quantity <= 20 and (l_returnflag = 'A' or l_returnflag = 'R')
          and l_discount < 0.05 and l_tax >= 0.02 and l_linestatus <> 'F' and l_linenumber <> 3""",
    "filter_ci_equality": """
        select c_custkey, c_mktsegment from customer
        where c_mktsegment in ('BUILDING', 'MACHINERY')
          and not (c_mktsegment >= 'b' and c_mktsegment < 'M')
        union all
        select c_custkey, c_mktsegment from customer
        where c_mktsegment in ('BUILDING', 'MACHINERY') and c_mktsegment >= 'M'""",
    "filter_ilike": "select p_partkey, p_type from part where lower(p_type) like 's%ard'",
    "remove_by_attributes": sql_with("src") + NOT_REMOVED,
    "remove_by_many_sets": sql_with("src")
    + """select id, cust, status, price, odate from src
         where not coalesce((status = 'F' and cust between 1 and 250) or status is null, false)""",
    "remove_by_criteria_table": sql_with("tgt")
    + """select t.* from tgt t left join customer c on c.c_custkey = t.cust
         where not (t.status = 'F' and coalesce(c.c_nationkey < 5, false))""",
    "attribute_sets_parse": """
        select c_custkey, 2 as n_sets, c_mktsegment as seg, true as has_null_seg, true as seg_is_null from customer""",
    "bulk_refresh": sql_with("src")
    + "select id, cust, status, price, odate, cast(null as varchar) as note from src",
    "bulk_truncate_count": sql_with("tgt_null") + "select count(k1) as num_deleted from tgt_null",
    "bulk_delete_count": sql_with("tgt_null") + "select count(*) as num_deleted from tgt_null",
    "runlog_status": sql_with("runs")
    + """select count(*) filter (where status = 'queued') as num_queued_jobs,
                count(*) filter (where status = 'in_process') as num_in_process_jobs,
                count(*) filter (where status = 'finished') as num_finished_jobs,
                count(*) filter (where status = 'failed') as num_failed_jobs
         from runs""",
    "runlog_list": sql_with("runs") + "select * from runs order by time_added desc, id",
    "runlog_get": sql_with("runs") + "select * from runs where id = 42",
    "runlog_expire": sql_with("runs")
    + """select * from runs
         where status in ('queued', 'in_process') or time_finished >= timestamp '2024-01-20 00:00:00'""",
    "runlog_json": sql_with("runs")
    + """select cast(id as varchar) as id,
                strftime(time_added, '%Y-%m-%dT%H:%M:%SZ') as added,
                case when status in ('finished', 'failed')
                     then strftime(time_finished, '%Y-%m-%dT%H:%M:%SZ') end as finished,
                case when id % 2 = 0 then 'a = 1' end as filter,
                case when id % 2 <> 0 then '[{"a":"1","b":null}]' end as sets,
                case when status in ('finished', 'failed') then cast(id as varchar) end as created
         from runs""",
    "nearest_layer_name": """
        with layers(name, position) as (
            values ('customer', 1), ('events', 2), ('lineitem', 3), ('nation', 4),
                   ('orders', 5), ('part', 6), ('region', 7), ('supplier', 8)),
        scored as (
            select p_partkey, lower(split_part(p_type, ' ', 1)) as wanted, name, position,
                   levenshtein(lower(split_part(p_type, ' ', 1)), name) as distance
            from part, layers),
        best as (
            select *, row_number() over (partition by p_partkey order by distance, position) as rn from scored)
        select p_partkey, wanted, case when distance < 12 then name end as name,
               case when distance < 12 then cast(distance as integer) end as distance
        from best where rn = 1""",
    "name_normalise": """
        select p_partkey as key, p_name as trimmed, lower(p_name) as lowered,
               cast(length(p_name) - length(replace(p_name, ' ', '')) + 1 as integer) as n_parts,
               replace(p_name, ' ', '+') as joined, replace(p_name, 'e', 'ee') as replaced,
               cast(levenshtein(p_name, 'almond') as integer) as distance
        from part""",
    "value_text": """
        select o_orderkey, printf('%.6f', o_totalprice) as fixed, strftime(o_orderdate, '%Y-%m-%d') as day,
               strftime(o_orderdate, '%H:%M:%S') as clock, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as stamp,
               strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as instant
        from orders""",
    "geom_srid_plan": sql_with("pts")
    + """select id, cast(srid as integer) as kept, 0 as undefined, 3857 as moved, srid = 4326 as bytes_differ
         from pts""",
    "geom_reproject_points": sql_with("pts")
    + """select id, round(radians(x) * 6378137.0, 3) as mx,
                round(ln(tan(pi() / 4 + radians(y) / 2)) * 6378137.0, 3) as my,
                round(cast(y as double), 6) as lat, round(cast(x as double), 6) as lon
         from pts""",
    "geom_utm_points": sql_with("pts")
    + """, c as (select 1 / 298.257223563 / (2 - 1 / 298.257223563) as n, sqrt(1 / 298.257223563 * (2 - 1 / 298.257223563)) as e),
         k as (select n, e, 0.9996 * 6378137.0 / (1 + n) * (1 + n * n / 4 + n ** 4 / 64) as a,
                      n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180 as a1,
                      13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440 as a2,
                      61 * n ** 3 / 240 - 103 * n ** 4 / 140 as a3, 49561 * n ** 4 / 161280 as a4 from c),
         r as (select id, cast(15 + x / 60 as double) as lon, cast(y as double) as lat, radians(cast(x as double) / 60) as l,
                      sin(radians(cast(y as double))) as s from pts),
         t as (select r.*, k.*, sinh(atanh(s) - e * atanh(e * s)) as t from r cross join k),
         z as (select *, atan2(t, cos(l)) as xi, asinh(sin(l) / sqrt(t * t + cos(l) * cos(l))) as eta from t)
         select id, 32633 as srid,
                round(500000 + a * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta)
                                    + a3 * cos(6 * xi) * sinh(6 * eta) + a4 * cos(8 * xi) * sinh(8 * eta)), 3) as east,
                round(a * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta)
                           + a3 * sin(6 * xi) * cosh(6 * eta) + a4 * sin(8 * xi) * cosh(8 * eta)), 3) as north,
                round(radians(lon) * 6378137.0, 3) as mx, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 3) as my
         from z""",
    "geom_is_collection": """
        select c_custkey, c_custkey % 7 + 1 as kind, c_custkey % 7 + 1 >= 4 as collection,
               case when c_custkey % 2 = 0 then 3 else 2 end as dims
        from customer""",
    "geom_from_hex": sql_with("pts")
    + "select id, case when id % 2 = 0 then 4326 else 3857 end as srid, true as same_bytes from pts",
    "geom_changed": sql_with("pts") + "select id, id % 6 in (2, 3, 4) as changed from pts",
    "pull_published": sql_with("src", "tgt") + RESULT_FULL,
    "pull_published_bucketed": sql_with("src", "tgt") + RESULT_FULL,
    "pull_counters": sql_with("src_dirty")
    + f""", good as ({GOOD_DIRTY})
         select 'finished' as status,
                (select count(*) from src_dirty) as num_pulled,
                (select count(*) from good where id % 4 = 0) as num_created,
                (select count(*) from good where id % 4 <> 0 and id % 9 = 0 and dbl is distinct from -1.0) as num_updated,
                (select count(*) from src_dirty where id % 4 <> 0 and (user_txt = 'n/a' or day_txt = 'n/a')) as num_deleted,
                (select count(*) from src_dirty) - (select count(*) from good) as num_ignored""",
    "pull_filtered_published": sql_with("src", "tgt") + RESULT_FILTERED,
    "pull_override_published": sql_with("src_segment", "tgt")
    + """select t.id, t.cust, case when s.cust is null then t.status else s.status end as status,
                t.price, t.odate, t.note
         from tgt t left join src_segment s on t.cust = s.cust""",
    "pull_override_inserts_published": sql_with("src_segment", "tgt")
    + """select t.id, t.cust, case when s.cust is null then t.status else s.status end as status,
                t.price, t.odate, t.note
         from tgt t left join src_segment s on t.cust = s.cust
         union all
         select null, cust, status, null, null, null from src_segment s
         where not exists (select 1 from tgt t where t.cust = s.cust)""",
    "pull_filter_ci_published": sql_with("src", "tgt")
    + """, f as (select * from src where lower(src_only) in ('1-urgent', '2-high') and status ilike 'f%' and price > 50000)
         select s.id, s.cust, s.status, s.price, s.odate, t.note from f s left join tgt t on t.id = s.id
         union all
         select t.id, t.cust, t.status, t.price, t.odate, t.note from tgt t
         where not exists (select 1 from f s where s.id = t.id)""",
    "pull_on_change_sets_published": sql_with("src", "tgt") + RESULT_FULL,
    "source_csv_published": sql_with("src", "tgt") + RESULT_FULL,
    "source_geojson_published": sql_with("pts")
    + """select id, cast(srid as integer) as code, 3857 as srid,
                round(radians(x) * 6378137.0, 3) as mx, round(ln(tan(pi() / 4 + radians(y) / 2)) * 6378137.0, 3) as my
         from pts""",
    "source_geojson_document_published": sql_with("pts")
    + """select id, case id % 3 when 0 then '}]},{"type":"Feature"' when 1 then '{[[' else chr(92) end as note,
                cast(x as double) as x, cast(y as double) as y from pts""",
    "source_wkt_published": sql_with("pts")
    + """select id, (select count(*) from pts where id % 10 = 0) as ignored, cast(srid as integer) as srid,
                cast(case id % 3 when 0 then 1 when 1 then 2 else 6 end as bigint) as kind,
                cast(case id % 3 when 0 then 1 when 1 then 2 else 4 end as integer) as n,
                cast(x as double) as x, cast(y as double) as y,
                cast(case id % 3 when 1 then x + 1 else x end as double) as last_x,
                cast(case id % 3 when 1 then y + 2 else y end as double) as last_y
         from pts where id % 10 <> 0""",
    "source_gml_published": sql_with("pts")
    + """select id, (select count(*) from pts where id % 10 = 0) as ignored,
                round(radians(x) * 6378137.0, 3) as mx, round(ln(tan(pi() / 4 + radians(y) / 2)) * 6378137.0, 3) as my
         from pts where id % 10 <> 0""",
    "geom_truncated_quarantined": sql_with("pts")
    + """select id, cast(case id % 8 when 2 then 3 when 5 then 7 else 2 end as bigint) as kind,
                cast(case id % 8 when 2 then 77 when 5 then 9 else 41 end as integer) as n_bytes,
                (select count(*) from pts where id % 8 in (0, 3, 4, 6, 7)) as ignored,
                (select count(*) from pts where id % 8 in (1, 2, 5)) as created
         from pts where id % 8 in (0, 1, 2, 4, 5)""",
    "failures_change_nothing": sql_with("tgt")
    + """select v.*, (select count(*) from tgt where status is not null) as rows
         from (values ('plain', 'failed', 'filter'), ('plain', 'failed', 'rule'), ('words', 'failed', 'value'),
                      ('shapes', 'failed', 'rule'), ('plain', 'failed', 'deletion'), ('absent', 'failed', 'near layer')
              ) as v(layer_name, status, reason)""",
    "run_by_id": sql_with("src", "tgt")
    + """, f as (select * from src where price > 50000)
         select 'finished' as status, 'layer' as "layerName", 'pull' as type, 'price > 50000' as filter,
                cast((select count(*) from f) as varchar) as "numPulled", '0' as "numCreated", '0' as "numUpdated" from (select 1)""",
    "pull_filter_text_ci_published": sql_with("src", "tgt")
    + """, f as (select * from src where not (lower(src_only) = '3-medium' or lower(src_only) in ('4-not specified', 'none'))
                 and (lower(status) like 'f%' or status is null or (lower(status) <> 'o' and price < 90000))
                 and src_only < '2-h' and status >= 'A')
         select s.id, s.cust, s.status, s.price, s.odate, t.note from f s left join tgt t on t.id = s.id
         union all
         select t.id, t.cust, t.status, t.price, t.odate, t.note from tgt t
         where not exists (select 1 from f s where s.id = t.id)""",
    "pull_changed_files_published": sql_with("src", "tgt")
    + """, held as (
           select * from src where id % 3 = 0 or (id % 3 = 2 and id % 5 = 0)
           union all
           select id, cust, status, price + 1, odate, src_only from src where id % 3 = 1 and id % 4 <> 0),
         n as (select (select count(*) from src) as first_read,
                      (select count(*) from held where id % 3 <> 0) as second_read, true as third_idle)
         select s.id, s.cust, s.status, s.price, s.odate, t.note, n.* from held s cross join n left join tgt t on t.id = s.id
         union all
         select t.*, n.* from tgt t cross join n where not exists (select 1 from src s where s.id = t.id)""",
    "bulk_published": sql_with("src")
    + "select id, cust, status, price, odate, cast(null as varchar) as note from src",
    "remove_published": sql_with("src") + NOT_REMOVED,
    "change_feed_published": sql_with("src", "tgt")
    + f"""select id, case when op = 'delete' then old_cust else new_cust end as cust,
                 case when op = 'delete' then old_status else new_status end as status,
                 case when op = 'delete' then old_price else new_price end as price,
                 case when op = 'delete' then old_odate else new_odate end as odate, note, op
          from ({CLASSIFIED}) where op <> 'same'""",
    "partitions_overwritten": sql_with("src", "tgt")
    + """select s.id, s.cust, s.price, t.note, s.status from src s left join tgt t on t.id = s.id
         union all
         select t.id, t.cust, t.price, t.note, t.status from tgt t
         where not exists (select 1 from src s where s.id = t.id)""",
    "partitions_null_and_escaped": sql_with("src", "tgt")
    + "select s.id, t.note, 'z' as part from src s left join tgt t on t.id = s.id",
    "geom_bad_values_quarantined": sql_with("pts")
    + "select id, id % 10 = 0 or y + 10 > 85.06 as bad from pts",
    "geojson_lines_quarantined": sql_with("pts")
    + """select id, cast(x as double) as x, cast(y as double) as y,
                (select count(*) from pts where id % 10 = 0) as ignored
         from pts where id % 10 <> 0""",
    "source_xml_published": sql_with("pts") + "select id, cast(srid as integer) as code from pts",
    "remove_bad_literal": sql_with("src")
    + "select id, cust, status, price, odate, cast(1 as bigint) as failed from src",
    "stream_layer_filter": sql_with("src", "tgt")
    + """select s.id, s.cust, s.status, s.price, s.odate, t.note
         from src s left join tgt t on t.id = s.id where s.status = 'F'
         union all
         select t.id, t.cust, t.status, t.price, t.odate, t.note from tgt t
         where not exists (select 1 from src s where s.id = t.id and s.status = 'F')""",
    "stream_late_rows_published": """
        select user_id, event_id, event_type, value from events
        qualify row_number() over (partition by user_id order by event_id desc) = 1""",
    "stream_incremental": sql_with("src", "tgt") + RESULT_NO_DELETE,
}
