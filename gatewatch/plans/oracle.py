"""The same results as plain SQL over the same tables. Windows are written as self-joins, unlike the Spark plans."""

from __future__ import annotations

from gatewatch.schemas import FEATURE_COLUMNS, NULL_TEXTS, PARSED_COLUMNS

LOG = """
with b as (
  select event_id, ((cast(floor(epoch(ts)) as bigint) - 1704067200) // 300) * 30 as t, user_id as u,
         event_type as y, cast(json_extract_string(props, '$.k') as bigint) as k, value
  from events),
log as (
  select event_id as seq, t as time,
    case when event_id % 101 = 0 then null when event_id % 97 = 0 then '?' else 'U' || cast(u % 20 as varchar) end as src_user,
    'U' || cast((u + k) % 30 as varchar) as dst_user,
    case when event_id % 89 = 0 then '-' else 'C' || cast((u * 31 + k) % 40 as varchar) end as src_computer,
    'D' || cast(k % 25 as varchar) as dst_computer,
    'NTLM' as auth_type,
    case y when 'purchase' then 'Network' when 'view' then '3' when 'error' then '8' when 'click' then 'Interactive' else 'Batch' end as logon_type,
    'LogOn' as auth_orientation,
    case y when 'error' then 'Fail' when 'signup' then 'Other' else 'Success' end as result,
    cast(case y when 'error' then 4625 when 'signup' then 0 else 4624 end as smallint) as event_id,
    value
  from b),
attacks as (select distinct time, src_user, src_computer, dst_computer from log where result = 'Fail' and value > 80),
parsed as (
  select l.time as "timestamp", l.src_user as src_username, l.dst_user as username, l.src_computer as src_host,
    l.dst_computer as destination_host, l.logon_type, l.event_id,
    cast(case when a.time is null then 0 else 1 end as integer) as label, l.seq
  from log l left join attacks a on l.time = a.time and l.src_user is not distinct from a.src_user
    and l.src_computer is not distinct from a.src_computer and l.dst_computer is not distinct from a.dst_computer)
"""

RAW = LOG + """,
raw as (
  select seq,
    case when seq % 53 = 0 then 'abc' when seq % 59 = 0 then time || '.7' else ' ' || time || ' ' end as time,
    case when seq % 61 = 0 then ' NA ' else '  ' || src_user || chr(9) end as src_user,
    dst_user || ' ' as dst_user,
    case when seq % 67 = 0 then 'null' else ' ' || src_computer end as src_computer,
    chr(9) || dst_computer as dst_computer, auth_type, ' ' || logon_type as logon_type, auth_orientation, result || ' ' as result
  from log)
"""

SCORED = LOG + """,
scored as (
  select seq, time as "timestamp", least(value / 100.0, 1.0) as probability, cast(seq % 37 = 0 as integer) as label,
    cast(least(value / 100.0, 1.0) >= 0.3 as integer) as prediction
  from log)
"""


def _clean(c: str) -> str:
    texts = ", ".join(f"'{t}'" for t in NULL_TEXTS)
    trimmed = f"trim({c}, ' ' || chr(9))"
    return f"case when {trimmed} in ({texts}) then null else {trimmed} end"


def _clean_time(c: str = "time") -> str:
    return f"cast(trunc(try_cast(trim({c}) as double)) as bigint)"


def _valid(*columns: str) -> str:
    return "(" + " and ".join(f"({c} is not null and {c} not in ('', '?', '-'))" for c in columns) + ")"


def _prior(keys: list[str], window: int | None, value: str, where: str = "true", time: str = '"timestamp"', table: str = "parsed") -> str:
    """Aggregate ``value`` over the rows of ``table`` (as b) that come before row a and share its keys."""
    same = " and ".join(f"b.{k} = a.{k}" for k in keys)
    limit = f" and b.{time} >= a.{time} - {window}" if window is not None else ""
    return (f"select a.seq, {value} as v from {table} a join {table} b on {same} and (b.{time}, b.seq) < (a.{time}, a.seq){limit} "
            f"where {where} group by a.seq")


def _feature(name: str) -> tuple[str, str]:
    """Sub-query giving ``seq, v``, and the expression that turns v into the feature."""
    user, source, target = "src_username", "src_host", "destination_host"
    n = "cast(coalesce(v, 0) as integer)"
    counts = {
        "auth_attempts_5m_per_src_user": (_prior([user], 300, "count(*)"), n),
        "successful_auths_5m_per_src_user": (_prior([user], 300, "count(*) filter (b.event_id = 4624)"), n),
        "unique_src_computers_1h_per_src_user": (_prior([user], 3600, f"count(distinct b.{source})"), n),
        "unique_dst_computers_5m_per_src_user": (_prior([user], 300, f"count(distinct b.{target})"), n),
        "unique_dst_computers_1h_per_src_user": (_prior([user], 3600, f"count(distinct b.{target})"), n),
        "unique_dst_users_1h_per_src_computer": (_prior([source], 3600, "count(distinct b.username)"), n),
        "unique_src_users_1h_per_dst_computer": (_prior([target], 3600, f"count(distinct b.{user})"), n),
        "prior_auth_count_1h_src_user_dst_computer": (_prior([user, target], 3600, "count(*)", _valid(f"a.{user}", f"a.{target}")), n),
    }
    if name in counts:
        return counts[name]
    pairs = {"is_first_seen_src_user_src_computer": [user, source], "is_first_seen_src_user_dst_computer": [user, target],
             "is_first_seen_src_computer_dst_computer": [source, target]}
    if name in pairs:
        keys = pairs[name]
        return _prior(keys, None, "count(*)"), f"cast({_valid(*keys)} and v is null as integer)"
    keys = {"seconds_since_last_auth_by_src_user": [user], "seconds_since_last_src_user_dst_computer": [user, target]}[name]
    return (_prior(keys, None, 'max(b."timestamp")'),
            f"""cast(case when {_valid(*keys)} and v is not null then "timestamp" - v else -1 end as bigint)""")


CONTEXT = {
    "current_event_is_success": "cast(event_id = 4624 as integer)",
    "hour_of_day": """cast(("timestamp" % 86400) // 3600 as integer)""",
    "is_network_logon": "cast(logon_type in ('Network', '3', '8') as integer)",
}


def _one_feature(name: str) -> str:
    sub, value = _feature(name)
    return LOG + f"select p.seq, {value} as {name} from parsed p left join ({sub}) f on f.seq = p.seq"


def _all_features(columns: str = '"timestamp", {features}, label, seq', tail: str = "") -> str:
    parts, joins, values = [], [], []
    for i, name in enumerate(FEATURE_COLUMNS):
        if name in CONTEXT:
            values.append(f"{CONTEXT[name]} as {name}")
            continue
        sub, value = _feature(name)
        parts.append(f"f{i} as ({sub})")
        joins.append(f"left join f{i} on f{i}.seq = p.seq")
        values.append(f"{value.replace('v', f'f{i}.v') if value.startswith('cast(coalesce') else _qualify(value, i)} as {name}")
    features = LOG + ", " + ",\n".join(parts) + f""",
features as (select p."timestamp", {", ".join(values)}, p.label, p.seq from parsed p {" ".join(joins)})
"""
    return features + f"select {columns.format(features=', '.join(FEATURE_COLUMNS))} from features {tail}"


def _qualify(value: str, i: int) -> str:
    import re

    return re.sub(r"\bv\b", f"f{i}.v", value)


def _rates(tn: str, fp: str, fn: str, tp: str) -> dict[str, str]:
    def ratio(top, bottom):
        return f"round(case when {bottom} > 0 then ({top}) / ({bottom})::double else 0.0 end, 9)"

    return {"accuracy": ratio(f"{tp} + {tn}", f"({tn} + {fp} + {fn} + {tp})"), "precision": ratio(tp, f"({tp} + {fp})"),
            "recall": ratio(tp, f"({tp} + {fn})"), "f1": ratio(f"2 * {tp}", f"(2 * {tp} + {fp} + {fn})")}


MATRIX = """
m as (select count(*) filter (label = 0 and prediction = 0) as true_negative, count(*) filter (label = 0 and prediction = 1) as false_positive,
             count(*) filter (label = 1 and prediction = 0) as false_negative, count(*) filter (label = 1 and prediction = 1) as true_positive
      from scored)
"""
M = _rates("true_negative", "false_positive", "false_negative", "true_positive")
RATES = ", ".join(f"{v} as {k}" for k, v in M.items())

RANKING = """
s as (select probability as score, sum(label) as p, sum(1 - label) as n from scored group by 1),
c as (select a.score, a.p, a.n, sum(b.p) as cp, sum(b.n) as cn from s a join s b on b.score >= a.score group by 1, 2, 3),
r as (select sum(n * (cp - p / 2.0)) / (sum(p) * sum(n))::double as roc_auc, sum(p * cp / (cp + cn)::double) / sum(p)::double as pr_auc from c)
"""

CURVE = """
h as (select cast(least(floor(greatest(least(probability, 1.0), 0.0) * 10000), 10000) as integer) as bin, sum(label) as p, sum(1 - label) as n
      from scored group by 1),
g as (select cast(range as integer) as bin from range(10001)),
w as (select g.bin, cast(coalesce(sum(h.p), 0) as bigint) as true_positive, cast(coalesce(sum(h.n), 0) as bigint) as false_positive
      from g left join h on h.bin >= g.bin group by g.bin),
q as (select *, (select sum(label) from scored) - true_positive as false_negative,
        case when true_positive + false_positive > 0 then true_positive / (true_positive + false_positive)::double else 0.0 end as precision,
        true_positive / (select sum(label) from scored)::double as recall from w),
curve as (select bin, true_positive, false_positive, cast(false_negative as bigint) as false_negative, precision, recall,
        case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end as f1 from q)
"""

SPLIT = """case "timestamp" // 86400 - (select min("timestamp") // 86400 from parsed) when 0 then 'train' when 1 then 'valid' when 2 then 'test' end"""

EVENTS = LOG + """,
xml as (
  select seq, case when seq % 10 = 0 then null else seq // 3 end as record_id,
    case when seq % 71 = 0 then null else time + 1704067200 end as "timestamp", cast(event_id as bigint) as event_id,
    coalesce(src_user, '-') as src_username, dst_user as username,
    case when src_computer = '-' then '10.0.0.1' else src_computer end as src_host, dst_computer as destination_host, logon_type
  from log where event_id in (4624, 4625))
"""
LIVE = 'record_id, "timestamp", event_id, src_username, username, src_host, destination_host, logon_type'


def _raw_rolling(keys: list[str], window: int, value: str) -> str:
    return _prior(keys, window, value, time="time", table="log")


def _legacy() -> str:
    user, source = "src_username", "src_host"
    failed = "count(*) filter (b.event_id = 4625)"
    return LOG + f""",
a1 as ({_prior([user], 300, failed)}), a2 as ({_prior([user], 3600, f"count(distinct b.{source})")}),
a3 as ({_prior([source], 300, failed)}), a4 as ({_prior([user], 3600, failed)}), a5 as ({_prior([user], 3600, "count(*)")}),
a6 as ({_prior([source], 3600, f"count(distinct b.{user})")})
select p."timestamp", cast(coalesce(a1.v, 0) as integer) as failed_logins_5m_user, cast(coalesce(a2.v, 0) as integer) as unique_src_ip_1h,
  cast(coalesce(a3.v, 0) as integer) as failed_logins_5m_ip, round(case when a5.v > 0 then a4.v / a5.v::double else 0.0 end, 9) as failure_rate_1h,
  cast(coalesce(a6.v, 0) as integer) as unique_users_1h_per_ip, cast(("timestamp" % 86400) // 3600 as integer) as hour_of_day,
  cast(("timestamp" // 86400) % 7 as integer) as day_of_week,
  cast((("timestamp" % 86400) // 3600 between 8 and 17) and (("timestamp" // 86400) % 7 between 0 and 4) as integer) as is_business_hours,
  cast(logon_type in ('Network', '3', '8') as integer) as is_network_logon, p.label, p.seq
from parsed p left join a1 on a1.seq = p.seq left join a2 on a2.seq = p.seq left join a3 on a3.seq = p.seq
  left join a4 on a4.seq = p.seq left join a5 on a5.seq = p.seq left join a6 on a6.seq = p.seq"""


STATS = """select {split} as split, count(*) as n_rows, count(*) filter (label = 0) as benign, count(*) filter (label = 1) as anomaly,
  min("timestamp") as min_timestamp, max("timestamp") as max_timestamp from parsed group by 1"""


ORACLE: dict[str, str] = {
    "scan_auth_log": RAW + "select time, src_user, dst_user, src_computer, dst_computer, auth_type, logon_type, auth_orientation, result from raw",
    "scan_attack_labels": LOG + "select *, cast(1 as integer) as label from attacks",
    "parse_log": RAW + f"""select {_clean_time('r.time')} as "timestamp", {_clean('r.src_user')} as src_username, {_clean('r.dst_user')} as username,
        {_clean('r.src_computer')} as src_host, {_clean('r.dst_computer')} as destination_host, {_clean('r.logon_type')} as logon_type,
        cast(case {_clean('r.result')} when 'Success' then 4624 when 'Fail' then 4625 else 0 end as smallint) as event_id,
        cast(case when a.time is null then 0 else 1 end as integer) as label
      from raw r left join attacks a on {_clean_time('r.time')} = a.time and {_clean('r.src_user')} is not distinct from a.src_user
        and {_clean('r.src_computer')} is not distinct from {_clean('a.src_computer')} and {_clean('r.dst_computer')} = a.dst_computer
      where {_clean_time('r.time')} is not null""",
    "write_parsed": LOG + f"""select {', '.join('"' + c + '"' for c in PARSED_COLUMNS)}, seq, cast("timestamp" // 86400 as integer) as day from parsed""",
    "scan_parsed": LOG + "select src_username, count(*) as n_rows, cast(sum(label) as bigint) as n_labels from parsed group by 1",
    "write_features": _all_features('"timestamp", {features}, label'),
    "write_splits": LOG + f"""select {SPLIT} as split, count(*) as n_rows, cast(sum("timestamp") as bigint) as sum_timestamp from parsed group by 1""",
    "write_report": LOG + f"""select true as valid, 'auth_anomaly_v2' as feature_schema_version, count(*) as total_rows, cast(sum(label) as bigint) as total_anomaly,
        min("timestamp") // 86400 as first_day_index, count(*) filter ({SPLIT} = 'train') as train_rows,
        max("timestamp") filter ({SPLIT} = 'test') as last_timestamp from parsed""",
    "scan_model_matrix": _all_features("count(*) as n_rows, " + ", ".join(f"cast(sum({c}) as double) as {c}" for c in FEATURE_COLUMNS)),
    "write_metrics": SCORED + "," + MATRIX + "," + RANKING + f"""select 'demo' as model, true_positive, false_positive, {M['accuracy']} as accuracy,
        round(roc_auc, 9) as roc_auc, round(pr_auc, 9) as pr_auc, cast(0.3 as double) as threshold from m, r""",
    "scan_event_xml": EVENTS + f"select {LIVE} from xml",
    "scan_event_xml_lines": EVENTS + f"select {LIVE} from xml",
    "rejected_event_xml": LOG + "select seq, case when seq % 17 = 0 then 'not readable' else 'other name space' end as reason from log where seq % 17 = 0 or seq % 19 = 0",
    "clean_time": RAW + f"select seq, {_clean_time()} as time from raw where {_clean_time()} is not null",
    "normalize_text": RAW + "select seq, " + ", ".join(f"{_clean(c)} as {c}" for c in ("src_user", "dst_user", "src_computer", "dst_computer", "logon_type", "result")) + " from raw",
    "map_event_id": LOG + "select seq, event_id from log",
    "to_canonical": LOG + f"""select {', '.join('"' + c + '"' for c in PARSED_COLUMNS if c != 'label')}, cast(0 as integer) as label, seq from parsed""",
    "hour_of_day": LOG + "select seq, cast(((((time - 100000) % 86400) + 86400) % 86400) // 3600 as integer) as hour_of_day from log",
    "is_network_logon": LOG + "select seq, cast(src_user is not null and logon_type in ('Network', '3', '8') as integer) as is_network_logon from log",
    "is_success": LOG + "select seq, cast(result = 'Success' as integer) as is_success from log",
    "valid_key": LOG + f"select seq, {_valid('src_user', 'src_computer')} as valid from log",
    "coerce_label": LOG + "select seq, cast(case when result = 'Fail' then 1 when result = 'Other' then 0 when src_user = 'U3' then 1 else 0 end as integer) as label from log",
    "relative_day": LOG + "select seq, cast(time // 86400 - (select min(time) // 86400 from log) as integer) as relative_day from log",
    "apply_threshold": SCORED + "select seq, prediction from scored",
    "parse_event_time": LOG + "select seq, case when seq % 11 = 0 then null else time + 1704067200 end as epoch from log",
    "parse_event_xml": EVENTS + f"select seq, {LIVE} from xml",
    "alert_line": LOG + """select seq, '[' || case when least(value / 100.0, 1.0) >= 0.3 then 'ANOMALY' else 'NORMAL ' end || '] rec_id=' || seq || ' | time=' ||
        strftime(make_timestamp(time * 1000000), '%Y-%m-%d %H:%M:%S') || ' | id=' || event_id || ' | score=' || printf('%.5f', least(value / 100.0, 1.0)) ||
        ' (threshold=0.30000) | ' || coalesce(src_user, 'None') || '@' || src_computer || ' -> ' || dst_user || '@' || dst_computer as alert from log""",
    "scale_z": LOG + """select seq, round((value - (select avg(value) from log)) / (select stddev_pop(value) from log), 6) as value,
        round((time - (select avg(time) from log)) / (select stddev_pop(time) from log), 6) as clock, cast(0.0 as double) as flat from log""",
    "round_clip": LOG + """select seq, cast(least(greatest(round_even((seq % 17) / 2.0, 0), 1), 6) as bigint) as halves,
        least(greatest(value / 200, 0.1), 0.9)::double as share from log""",
    "clean_scores": LOG + """select seq, round(case when seq % 11 = 0 then 0.0 when seq % 13 = 0 then 1.0 when seq % 17 = 0 then 0.0
        else greatest(least(value / 100 - 0.05, 1.0), 0.0) end, 9)::double as score from log""",
    "minority_rows": LOG + """select seq, case when logon_type = '8' then 8.0 else 0.0 end::double as a, value as b from log where result = 'Fail'""",
    "label_join": LOG + "select seq, label from parsed",
    "dedup_labels": LOG + "select * from attacks",
    "dedup_records": LOG + """select seq, "timestamp", record_id, dst_user from (select seq, time as "timestamp", dst_user,
        case when seq % 10 = 0 then null else seq // 3 end as record_id, row_number() over (partition by case when seq % 10 = 0 then null else seq // 3 end
        order by time, seq) as rn from log) where rn = 1 or record_id is null""",
    "union_synthetic": SCORED + """select "timestamp", probability, cast(0 as integer) as is_synthetic, label from scored
        union all select "timestamp", probability, 1, label from scored where label = 1""",
    "knn_minority": """with x as (select vec_id as id, unnest(range(1, 65)) as dim, unnest(embedding)::double as v from embeddings),
        s as (select dim, avg(v) as m, stddev_pop(v) as d from x group by dim),
        z as (select id, dim, (v - m) / case when d = 0 then 1 else d end as z from x join s using (dim)),
        n as (select a.id, b.id as neighbour_id, row_number() over (partition by a.id order by sum((a.z - b.z) * (a.z - b.z)), b.id) as neighbour_rank
              from z a join z b on a.dim = b.dim and a.id <> b.id group by 1, 2)
        select id, cast(neighbour_rank as integer) as neighbour_rank, neighbour_id from n where neighbour_rank <= 5""",
    **{name: _one_feature(name) for name in FEATURE_COLUMNS if name not in CONTEXT},
    "event_context": LOG + "select seq, " + ", ".join(f"{v} as {k}" for k, v in CONTEXT.items()) + " from parsed",
    "build_features": _all_features(),
    "build_features_time_buckets": _all_features(),
    "build_features_hot_keys": _all_features(),
    "rolling_count": LOG + f""", x as ({_raw_rolling(['src_computer', 'dst_user'], 7200, 'count(*)')}),
        y as ({_raw_rolling(['src_computer', 'dst_user'], 86400, "count(*) filter (b.result = 'Fail')")})
        select l.seq, cast(coalesce(x.v, 0) as integer) as all_2h, cast(coalesce(y.v, 0) as integer) as failed_1d
        from log l left join x on x.seq = l.seq left join y on y.seq = l.seq""",
    "rolling_distinct": LOG + f""", x as ({_raw_rolling(['dst_user'], 1800, 'count(distinct b.src_user)')}),
        y as ({_raw_rolling(['dst_user'], 1800, 'count(distinct b.src_computer)')}), z as ({_raw_rolling(['dst_user'], 21600, 'count(distinct b.src_user)')})
        select l.seq, cast(coalesce(x.v, 0) as integer) as users_30m, cast(coalesce(y.v, 0) as integer) as hosts_30m, cast(coalesce(z.v, 0) as integer) as users_6h
        from log l left join x on x.seq = l.seq left join y on y.seq = l.seq left join z on z.seq = l.seq""",
    "first_seen": LOG + f"""select seq, cast({_valid('dst_user', 'src_computer', 'logon_type')} and
        row_number() over (partition by dst_user, src_computer, logon_type order by time, seq) = 1 as integer) as fresh from log""",
    "seconds_since_last": LOG + f"""select seq, cast(case when {_valid('src_computer')} then
        coalesce(time - lag(time) over (partition by src_computer order by time, seq), -1) else -1 end as bigint) as gap from log""",
    "legacy_features": _legacy(),
    "class_counts": LOG + "select label, count(*) as n_rows from parsed group by 1",
    "split_stats": LOG + STATS.format(split=SPLIT),
    "class_weight": LOG + """select count(*) filter (label = 0) as normal_rows, count(*) filter (label = 1) as anomaly_rows,
        round(count(*) filter (label = 0) / (count(*) filter (label = 1))::double, 9) as raw_scale_pos_weight,
        round(sqrt(count(*) filter (label = 0) / (count(*) filter (label = 1))::double), 9) as scale_pos_weight from parsed""",
    "score_histogram": SCORED + "," + CURVE + "select bin, cast(p as bigint) as positives, cast(n as bigint) as negatives from h",
    "threshold_curve": SCORED + "," + CURVE + """select bin, true_positive, false_positive, false_negative, round(precision, 9) as precision,
        round(recall, 9) as recall, round(f1, 9) as f1 from curve""",
    "select_threshold": SCORED + "," + CURVE + """, e as (select * from curve where recall >= 0.8),
        t1 as (select * from e where (select max(precision) from e) - precision <= 1e-12),
        t2 as (select * from t1 where (select max(f1) from t1) - f1 <= 1e-12)
        select round(bin / 10000.0, 9)::double as threshold, round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1, true_positive, false_positive,
          false_negative, cast(0.8 as double) as min_recall_target, true as recall_target_met, 'max_precision_at_min_recall' as threshold_strategy
        from t2 order by bin desc limit 1""",
    "confusion_matrix": SCORED + "," + MATRIX + "select * from m",
    "classification_metrics": SCORED + "," + MATRIX + f"select *, {RATES} from m",
    "classification_report": SCORED + "," + MATRIX + """,
        k as (select 'normal' as class, true_negative as hit, true_negative + false_negative as said, true_negative + false_positive as n from m
          union all select 'anomaly', true_positive, true_positive + false_positive, true_positive + false_negative from m),
        v as (select class, n, hit / said::double as p, hit / n::double as r, 2 * hit / (said + n)::double as f from k),
        o as (select class, p, r, f, n from v
          union all select 'accuracy', a, a, a, n from (select sum(hit) / sum(n)::double as a, sum(n) as n from k)
          union all select 'macro avg', avg(p), avg(r), avg(f), sum(n) from v
          union all select 'weighted avg', sum(p * n) / sum(n), sum(r * n) / sum(n), sum(f * n) / sum(n), sum(n) from v)
        select class, round(p, 9) as precision, round(r, 9) as recall, round(f, 9) as f1, cast(n as bigint) as support from o""",
    "roc_auc": SCORED + "," + RANKING + "select round(roc_auc, 9) as roc_auc from r",
    "average_precision": SCORED + "," + RANKING + "select round(pr_auc, 9) as pr_auc from r",
    "evaluate_model": SCORED + "," + MATRIX + "," + RANKING + f"""select 'demo' as model, {RATES}, true_negative, false_positive, false_negative, true_positive,
        round(roc_auc, 9) as roc_auc, round(pr_auc, 9) as pr_auc, cast(0.3 as double) as threshold from m, r""",
    "alert_volume": SCORED + """select "timestamp" // 86400 as day, count(*) as events, cast(sum(prediction) as bigint) as alerts,
        count(*) filter (prediction = 1 and label = 0) as false_positives from scored group by 1""",
    "check_sorted": LOG + """select * from (select seq, cast(floor(value) as bigint) as "timestamp", cast(lag(floor(value)) over (order by seq) as bigint) as previous from log)
        where "timestamp" < previous""",
    "check_columns": LOG + "select cast(logon_type in ('Network', '3', '8') as integer) as is_network_logon, count(*) as n_rows from parsed group by 1",
    "check_binary_label": LOG + """select case when src_user is not null then seq % 4 end as value, count(*) as n_rows from log
        where src_user is null or seq % 4 not in (0, 1) group by 1""",
    "check_no_nan": LOG + """select 'gaps' as column_name, count(*) as n_bad from log where seq % 101 = 0 having count(*) > 0
        union all select 'holes', count(*) from log where seq % 97 = 0 having count(*) > 0""",
    "check_three_days": LOG + """, d as (select cast(time * 2 // 86400 - (select min(time * 2) // 86400 from log) as integer) as relative_day, count(*) as n from log group by 1),
        w as (select cast(range as integer) as relative_day from range(3))
        select coalesce(d.relative_day, w.relative_day) as relative_day, coalesce(n, 0) as n_rows,
          case when w.relative_day is null then 'out of range' when n is null then 'empty' else 'ok' end as verdict
        from d full join w on d.relative_day = w.relative_day""",
    "check_conservation": LOG + """select count(*) as whole_rows, count(*) as part_rows, cast(sum(label) as bigint) as whole_positives,
        cast(sum(label) as bigint) as part_positives, true as conserved from parsed""",
    "check_min_positives": LOG + "select cast(sum(label) as bigint) as positives, sum(label) >= 2 as enough from parsed",
    "chronological_split": _all_features(
        '"timestamp", {features}, label, ' + SPLIT.replace("parsed", "features") + " as split"),
    "smote_invariants": LOG + f"""select cast(count(*) * 19 as bigint) as synthetic_rows, cast(0 as bigint) as not_between, cast(0 as bigint) as one_parent,
        cast(count(*) * 19 as bigint) as marked from parsed where label = 1 and {SPLIT} = 'train'""",
    "model_invariants": LOG + f"""select count(*) as n_rows, count(*) as counted, count(*) filter (label = 1) as positives, cast(0 as bigint) as outside,
        cast(0 as bigint) as changed, cast(0 as bigint) as replayed_otherwise, cast(16 as bigint) as importances, cast(1 as double) as importance
        from parsed where {SPLIT} = 'test'""",
    "train_weighted_invariants": LOG + f"""select count(*) filter ({SPLIT} = 'test') as n_rows, count(*) filter ({SPLIT} = 'test') as counted,
        count(*) filter ({SPLIT} = 'test' and label = 1) as positives, count(*) filter ({SPLIT} = 'train' and label = 0) as learned_normal,
        count(*) filter ({SPLIT} = 'train' and label = 1) as learned_positive, cast(0 as bigint) as outside, cast(0 as bigint) as changed,
        cast(16 as bigint) as importances, cast(1 as double) as importance, true as recall_reached, true as stopped from parsed""",
    "stream_score_invariants": LOG + "select count(*) as n_rows, cast(0 as bigint) as otherwise, cast(0 as bigint) as other_verdict from parsed",
    "smote_report": LOG + f""", c as (select count(*) filter (label = 0) as benign, count(*) filter (label = 1) as attack from parsed
          where {SPLIT} = 'train')
        select benign as benign_original, attack as attack_original, attack as attack_fit_sample, cast(attack * 19 as bigint) as synthetic_attack,
          cast(attack * 20 as bigint) as attack_after, true as all_original_train_rows_preserved, false as validation_test_modified,
          cast(20 as integer) as attack_multiplier, least(5, attack - 1) as k_neighbors, cast(42 as integer) as random_state from c""",
    "stream_features": _all_features(),
    "stream_features_out_of_order": _all_features(),
    "stream_features_keyed_state": _all_features(),
    "stream_dedup": LOG + """select record_id, case when record_id is null then n else 1 end as n_rows from
        (select case when seq % 10 = 0 then null else seq // 3 end as record_id, count(*) as n from log group by 1)""",
    "stream_dedup_marked": LOG + """, r as (select case when seq % 10 = 0 then null else seq // 3 end as record_id, "time" // 86400 + case when seq % 11 = 0 then 1 else 0 end as arrival,
        "time" + case when seq % 11 = 0 then -7200 when seq % 7 = 0 then 7200 else 0 end as t from log),
        g as (select record_id, list(t order by arrival, t) as a from r where record_id is not null group by 1),
        two as (select *, case when a[2] > a[1] + 3600 then 'kept' when a[2] < a[1] - 3600 then 'late' when a[2] is not null then 'repeated' end as s2 from g),
        three as (select *, case when s2 = 'kept' then a[2] else a[1] end as held from two),
        m as (select record_id, 'kept' as status from g union all select record_id, s2 from three
        union all select record_id, case when a[3] > held + 3600 then 'kept' when a[3] < held - 3600 then 'late' when a[3] is not null then 'repeated' end from three
        union all select null, 'kept' from r where record_id is null)
        select record_id, status, count(*) as n_rows from m where status is not null group by all""",
    "stream_sign_ins": EVENTS + """, g as (select record_id is null as unnumbered, "timestamp" is null as untimed, count(*) as n, count(distinct record_id) as d
        from xml group by 1, 2)
        select unnumbered, untimed, case when unnumbered or untimed then n else d end as n_rows from g""",
    "replay_in_time_order": LOG + """select seq, "timestamp", event_id, ("timestamp" - (select min("timestamp") from parsed)) // 28800 as batch from parsed""",
    "replay_scored_in_time_order": LOG + """, t as (select "timestamp" from parsed where "timestamp" // 86400 = (select min("timestamp") // 86400 + 2 from parsed))
        select ("timestamp" - (select min("timestamp") from t)) // 28800 as batch, count(*) as n_rows, min("timestamp") as first, max("timestamp") as last,
          cast(0 as bigint) as otherwise from t group by 1""",
    "stream_filter": LOG + "select event_id, count(*) as n_rows from log where event_id in (4624, 4625) group by 1",
}
