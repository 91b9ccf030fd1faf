"""The registered queries as plain SQL over the same tables, for an independent engine.

Each text starts from the base relations it needs: ``telemetry`` (events), ``windowed`` (one-day
windows) and ``predictions`` (windows with their profile label).
"""

from __future__ import annotations

METRICS = (
    "signal_strength_dbm",
    "throughput_mbps",
    "latency_ms",
    "call_drop_rate_percent",
    "packet_loss_percent",
    "jitter_ms",
)

_TELEMETRY = """
numbered as (
  select event_id, ts, value as v, user_id % 50 as c, cast(regexp_extract(props, '[0-9]+', 0) as int) as k
  from events),
kinds as (
  select *, v as f,
    case when c < 3 then 'anomaly'
         when c < 9 then case when k % 10 < 6 then 'anomaly' else 'normal' end
         when c < 24 then 'excellent'
         when k % 20 = 0 then 'anomaly' else 'normal' end as kind
  from numbered),
telemetry as (
  select event_id, ts, 'CELL_' || lpad(cast(c as varchar), 4, '0') as cell_id,
    '505' || cast(10 + k % 90 as varchar) || lpad(cast(event_id as varchar), 8, '0') as imsi,
    r_name as region,
    case kind when 'excellent' then -4e1 - floor(k*16e0)/1e2 when 'normal' then -45e0 - floor(k*3e1)/1e2 else -7e1 - floor(k*25e0)/1e2 end as signal_strength_dbm,
    case kind when 'excellent' then 9e1 + floor(f*35e0)/1e2 when 'normal' then 4e1 + floor(f*4e1)/1e2 else 2e0 + floor(f*19e0)/1e2 end as throughput_mbps,
    case kind when 'excellent' then 1e1 + floor(k*16e0)/1e2 when 'normal' then 1e1 + floor(f*2e1)/1e2 else 6e1 + floor(k*14e1)/1e2 end as latency_ms,
    case kind when 'excellent' then 1e-1 + floor(f*1e0)/1e3 when 'normal' then 2e-1 + floor(k*6e0)/1e3 else 1e0 + floor(f*2e1)/1e3 end as call_drop_rate_percent,
    case when event_id % 97 = 0 then null when kind = 'excellent' then 2e-2 + floor(k*15e-1)/1e3 when kind = 'normal' then 1e-1 + floor(f*2e0)/1e3 else 1e0 + floor(k*9e1)/1e3 end as packet_loss_percent,
    case kind when 'excellent' then 5e-1 + floor(f*5e-1)/1e2 when 'normal' then 1e0 + floor(k*3e0)/1e2 else 5e0 + floor(f*125e-1)/1e2 end as jitter_ms
  from kinds join region on r_regionkey = c % 5)"""

ANOMALY = (
    "(coalesce(latency_ms, 0) > 100 or coalesce(signal_strength_dbm, 0) < -80 "
    "or coalesce(call_drop_rate_percent, 0) > 2 or coalesce(packet_loss_percent, 0) > 5)"
)


def _milli(x: str) -> str:
    return f"cast(floor({x}*1e3+5e-1) as bigint)"


def _avg(m: str) -> str:
    return f"coalesce(floor(cast(sum({_milli(m)}) as double)/nullif(count({m}), 0)+5e-1)/1e3, 0e0)"


def _p95(m: str) -> str:
    ordered = f"list_sort(list({_milli(m)}) filter (where {m} is not null))"
    return f"coalesce({ordered}[least(19*count({m})//20, count({m})-1)+1]/1e3, 0e0)"


_WINDOWED = f""",
windowed as (
  select cell_id, date_trunc('day', ts) + interval 1 day as window_end, max(ts) as last_ts, min(region) as region,
    count(*) as event_count, count(*) filter (where {ANOMALY}) as anomaly_event_count,
    {", ".join(f"{_avg(m)} as avg_{m}" for m in METRICS)}
  from telemetry group by cell_id, date_trunc('day', ts))"""

# Two times the sum of the logarithms of a class's deviations closes each line.
_PREDICTIONS = """,
distances as (
  select *,
    power((avg_signal_strength_dbm + 5e1)/5e0, 2) + power((avg_throughput_mbps - 12e1)/2e1, 2) + power((avg_latency_ms - 2e1)/5e0, 2)
    + power((avg_call_drop_rate_percent - 3e-1)/15e-2, 2) + power((avg_packet_loss_percent - 2e-1)/1e-1, 2) + power((avg_jitter_ms - 15e-1)/5e-1, 2)
    + 2e0*(ln(5e0) + ln(2e1) + ln(5e0) + ln(15e-2) + ln(1e-1) + ln(5e-1)) as ex,
    power((avg_signal_strength_dbm + 65e0)/5e0, 2) + power((avg_throughput_mbps - 7e1)/15e0, 2) + power((avg_latency_ms - 45e0)/1e1, 2)
    + power((avg_call_drop_rate_percent - 1e0)/3e-1, 2) + power((avg_packet_loss_percent - 1e0)/4e-1, 2) + power((avg_jitter_ms - 35e-1)/1e0, 2)
    + 2e0*(ln(5e0) + ln(15e0) + ln(1e1) + ln(3e-1) + ln(4e-1) + ln(1e0)) as go,
    power((avg_signal_strength_dbm + 82e0)/5e0, 2) + power((avg_throughput_mbps - 25e0)/1e1, 2) + power((avg_latency_ms - 13e1)/3e1, 2)
    + power((avg_call_drop_rate_percent - 3e0)/8e-1, 2) + power((avg_packet_loss_percent - 4e0)/15e-1, 2) + power((avg_jitter_ms - 1e1)/3e0, 2)
    + 2e0*(ln(5e0) + ln(1e1) + ln(3e1) + ln(8e-1) + ln(15e-1) + ln(3e0)) as po
  from windowed),
predictions as (
  select cell_id, region, window_end, last_ts as timestamp, event_count, anomaly_event_count,
    case when ex <= go and ex <= po then 0 when go <= po then 1 else 2 end as encoded,
    case when ex <= go and ex <= po then 'excellent' when go <= po then 'good' else 'poor' end as label
  from distances)"""

_SAMPLES = f""",
samples as (
  select w.window_end, w.cell_id, w.region, w.event_count, {", ".join(f"avg_{m} as {m}" for m in METRICS)}, label as network_health_score
  from windowed w join predictions p on p.cell_id = w.cell_id and p.window_end = w.window_end)"""

_DIGEST = "md5({seed} || ':' || cell_id || ':' || strftime(window_end, '%Y-%m-%d %H:%M:%S'))"


def _events(body: str) -> str:
    return f"with {_TELEMETRY}\n{body}"


def _windows(body: str) -> str:
    return f"with {_TELEMETRY}{_WINDOWED}\n{body}"


def _predicted(body: str) -> str:
    return f"with {_TELEMETRY}{_WINDOWED}{_PREDICTIONS}\n{body}"


def _samples(body: str) -> str:
    return f"with {_TELEMETRY}{_WINDOWED}{_PREDICTIONS}{_SAMPLES}\n{body}"


def _since(column: str, days: int, table: str = "predictions") -> str:
    return f"{column} >= (select max({column}) from {table}) - interval {days} day"


def _each(pattern: str, joint: str = ", ") -> str:
    return joint.join(pattern.format(m=m) for m in METRICS)


def _stat_columns() -> str:
    return ", ".join(
        f"{_avg(m)} as {m}_avg, coalesce(floor(min({m})*1e3+5e-1)/1e3, 0e0) as {m}_min, "
        f"coalesce(floor(max({m})*1e3+5e-1)/1e3, 0e0) as {m}_max, {_p95(m)} as {m}_p95"
        for m in METRICS
    )


def _bin(column: str, seconds: int) -> str:
    return f"make_timestamp((epoch_us({column}) // {seconds * 1_000_000}) * {seconds * 1_000_000})"


def _tumbling(seconds: int) -> str:
    return _events(
        f"""select cell_id, {_bin('ts', seconds)} + interval {seconds} second as window_end, min(region) as region,
  count(*) as event_count, count(*) filter (where {ANOMALY}) as anomaly_event_count, {_stat_columns()}
from telemetry group by 1, 2"""
    )


_BANDS = {
    # Fixed values: [low, high] per archetype, in metric order.
    "poor_signal": ((-95, -80), (2, 15), (80, 200), (2, 5), (2, 8), (8, 20)),
    "high_latency": ((-70, -55), (10, 40), (150, 500), (1.5, 4), (1, 5), (10, 30)),
    "packet_storm": ((-65, -50), (5, 20), (50, 150), (1, 3), (5, 15), (15, 40)),
    "degraded": ((-80, -70), (15, 40), (60, 120), (2, 4), (2, 6), (5, 15)),
}


def _bands() -> str:
    rows = []
    for name, bands in _BANDS.items():
        bounds = ", ".join(f"{float(low)!r}::double, {float(high)!r}::double" for low, high in bands)
        rows.append(f"('{name}', {bounds})")
    names = ", ".join(f"lo{i}, hi{i}" for i in range(len(METRICS)))
    return f"(values {', '.join(rows)}) as b(archetype, {names})"


def _fits() -> str:
    return " and ".join(f"{m} between lo{i} and hi{i}" for i, m in enumerate(METRICS))


# The latency of each golden vector and its class.
_GOLDEN = ((15.0, "excellent"), (35.0, "good"), (120.0, "poor"))

_CUT_SHORT = "(event_id % 50 = 0 or event_id % 53 = 0 or event_id % 59 = 0 or event_id % 61 = 0 or event_id % 67 = 0)"

_QUALITY = """,
pairs as (
  select label, case when anomaly_event_count = 0 then 'excellent' when anomaly_event_count * 2 <= event_count then 'good' else 'poor' end as prediction
  from predictions),
sizes as (
  select c.class, (select count(*) from pairs where label = c.class) as actual,
    (select count(*) from pairs where prediction = c.class) as predicted,
    (select count(*) from pairs where label = c.class and prediction = c.class) as hits
  from (values ('excellent'), ('good'), ('poor')) as c(class)),
scores as (
  select *, coalesce(hits / nullif(cast(predicted as double), 0), 0) as p, coalesce(hits / nullif(cast(actual as double), 0), 0) as r from sizes)
select floor(sum(hits) / sum(actual)*1e6+5e-1)/1e6 as accuracy,
  floor(sum(actual * p) / sum(actual)*1e6+5e-1)/1e6 as precision,
  floor(sum(actual * r) / sum(actual)*1e6+5e-1)/1e6 as recall,
  floor(sum(actual * coalesce(2 * p * r / nullif(p + r, 0), 0)) / sum(actual)*1e6+5e-1)/1e6 as f1
from scores"""


def _standard(m: str) -> str:
    mean = f"(cast(sum({_milli(m)}) over () as double)/cast(count({m}) over () as double))"
    squares = f"(cast(sum(cast({_milli(m)}*{_milli(m)} as decimal(28,0))) over () as double)/cast(count({m}) over () as double))"
    deviation = f"sqrt(greatest({squares} - {mean}*{mean}, 0e0))"
    score = f"({m} - {mean}/1e3) / nullif({deviation}/1e3, 0e0)"
    return f"case when {m} is not null then coalesce(floor({score}*1e6+5e-1)/1e6, 0e0) end as {m}"


_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%fZ')"
_AGO = "(select max(timestamp) from predictions) - interval {} day"

_REPLY = f"""select 'distribution' as section, label as key, cast(to_json({{'count': count(*)}}) as varchar) as item
  from predictions where timestamp >= {_AGO.format(30)} group by label
union all select 'rate', '', cast(to_json({{'predictions': count(*)}}) as varchar) from predictions where timestamp >= {_AGO.format(1)}
union all select 'active', '', cast(to_json({{'active': count(*) > 0}}) as varchar) from predictions where timestamp >= {_AGO.format(1)}
union all select 'events', '', cast(to_json({{'total_events': cast(coalesce(sum(event_count), 0) as bigint), 'total_docs': count(*)}}) as varchar)
  from windowed where window_end >= {_AGO.format(5)}
union all select 'recent', {_ISO.format('timestamp')} || ' ' || cell_id,
  cast(to_json({{'cell_id': cell_id, 'region': region, 'label': label, 'timestamp': {_ISO.format('timestamp')}}}) as varchar)
  from (select * from predictions order by timestamp desc, cell_id limit 20)
union all select 'regions', region || ' ' || label, cast(to_json({{'region': region, 'label': label, 'count': count(*)}}) as varchar)
  from predictions where timestamp >= {_AGO.format(10)} group by region, label
union all select 'cells', cell_id, cast(to_json({{'region': region, 'signal_avg': avg_signal_strength_dbm, 'latency_avg': avg_latency_ms,
    'throughput_avg': avg_throughput_mbps, 'last_seen': {_ISO.format('window_end')}}}) as varchar)
  from (select * from windowed qualify row_number() over (partition by cell_id order by window_end desc) = 1)
union all select 'series', {_ISO.format("date_trunc('hour', timestamp)")}, cast(to_json({{
    'excellent': count(*) filter (where label = 'excellent'), 'good': count(*) filter (where label = 'good'),
    'poor': count(*) filter (where label = 'poor'), 'other': count(*) filter (where label not in ('excellent', 'good', 'poor'))}}) as varchar)
  from predictions where timestamp >= {_AGO.format(30)} group by date_trunc('hour', timestamp)"""


def oracle_sql() -> dict[str, str]:
    newest = "qualify row_number() over (partition by cell_id order by window_end desc) = 1"
    sliding = _events(
        f"""select cell_id, date_trunc('day', ts) + to_days(cast(d as int)) as window_end, min(region) as region,
  count(*) as event_count, count(*) filter (where {ANOMALY}) as anomaly_event_count, {_stat_columns()}
from telemetry, (values (1), (2), (3)) as days(d) group by 1, 2"""
    )
    archetypes = _events(
        f"select event_id, archetype from (select * from telemetry where {ANOMALY}) left join {_bands()} on {_fits()}"
    )
    features = "cell_id, window_end, " + _each("avg_{m}") + ", event_count, anomaly_event_count, region"
    return {
        # events
        "parse_telemetry": _events(
            f"select event_id, ts, case when event_id % 41 = 0 then 'unknown' else cell_id end as cell_id, region, {_each('{m}')} from telemetry where not {_CUT_SHORT}"
        ),
        "rejected_messages": _events(f"select event_id from telemetry where {_CUT_SHORT}"),
        "keyed_messages": _events(
            f"select cell_id as key, epoch_us(ts)/1e6 as timestamp, cell_id, imsi, region, {_each('{m}')} from telemetry"
        ),
        "anomaly_events": _events(f"select event_id, cell_id, ts, {_each('{m}')} from telemetry where {ANOMALY}"),
        "rounded_events": _events(
            "select event_id, "
            + ", ".join(
                f"floor({m}/8e0*1e{p}+5e-1)/1e{p} as {m}" for m, p in zip(METRICS, (2, 2, 2, 3, 3, 2))
            )
            + " from telemetry"
        ),
        "clamped_metrics": _events(
            """select event_id, greatest(-95e0, least(-30e0, signal_strength_dbm)) as signal_strength_dbm,
  greatest(5e0, least(200e0, throughput_mbps)) as throughput_mbps, greatest(5e0, least(80e0, latency_ms)) as latency_ms,
  greatest(0e0, call_drop_rate_percent) as call_drop_rate_percent,
  case when packet_loss_percent is not null then greatest(0e0, packet_loss_percent) end as packet_loss_percent,
  greatest(0e0, jitter_ms) as jitter_ms from telemetry"""
        ),
        "peak_latency": _events(
            """select event_id, peak_factor, floor(latency_ms/peak_factor*1e3+5e-1)/1e3 as normalised_latency_ms
from (select *, case when hour(ts) between 8 and 18 then 1e0 else 7e-1 end as peak_factor from telemetry)"""
        ),
        "id_check": _events(
            """select event_id, cell_id, imsi, regexp_matches(cell_id, '^CELL_[0-9]{4,}$') as cell_id_ok,
  regexp_matches(imsi, '^505[0-9]{10}$') as imsi_ok from telemetry"""
        ),
        "anomaly_archetype": archetypes,
        "archetype_bands": archetypes,
        "scorable_rows": _events(
            f"select event_id, cell_id, {_each('{m}')} from telemetry where {_each('{m} is not null', ' and ')}"
        ),
        "label_decode": _events(
            "select event_id, case event_id % 5 when 0 then 'excellent' when 1 then 'good' when 2 then 'poor' else 'unknown' end as label from telemetry"
        ),
        "iso_times": _events("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') as iso from telemetry"),
        # windows
        "window_stats": _tumbling(86_400),
        "window_stats_wide": _tumbling(5 * 86_400),
        "window_stats_narrow": _tumbling(600),
        "sliding_stats": sliding,
        "streamed_windows": _tumbling(86_400),
        "streamed_sliding": sliding,
        "window_region": _events(
            """select cell_id, date_trunc('day', ts) + interval 1 day as window_end,
  coalesce(nullif(min_by(r, (ts, r)) filter (where r is not null), ''), 'unknown') as region
from (select *, case event_id % 3 when 0 then null when 1 then '' else region end as r from telemetry) group by 1, 2"""
        ),
        "p95_exact": _events(
            "select cell_id, " + ", ".join(f"{_p95(m)} as {m}_p95" for m in METRICS) + " from telemetry group by cell_id"
        ),
        "p95_approx_ranks": _events(
            "select cell_id, " + ", ".join(f"count({m}) as {m}_n, count({m}) > 0 as {m}_near" for m in METRICS) + " from telemetry group by cell_id"
        ),
        "sample_per_cell": _events(
            "select cell_id, event_id, latency_ms from telemetry qualify row_number() over (partition by cell_id order by md5('42:' || event_id)) <= 100"
        ),
        # features
        "feature_rows": _windows(f"select {features} from windowed"),
        "latest_features": _windows(f"select {features} from windowed {newest}"),
        "online_upsert": _windows(
            f"select {features} from windowed {newest}"
        ),
        "feature_lookup": _windows(
            f"""select a.cell_id, {_each('avg_{m}')}, event_count, anomaly_event_count
from (select distinct cell_id from windowed where cast(substr(cell_id, 6) as int) % 7 = 3 union all select 'CELL_9999') as a
left join (select * from windowed {newest}) w on w.cell_id = a.cell_id"""
        ),
        "feature_store_status": _windows(
            "select count(distinct cell_id) as cells_materialized, max(window_end) as last_updated from windowed"
        ),
        "feature_age": _windows(
            """select cell_id, a as age_seconds, a < 300 as is_fresh,
  case when a < 60 then a || 's ago' when a < 3600 then cast(floor(a/6e1+5e-1) as bigint) || 'm ago' else cast(floor(a/36e2+5e-1) as bigint) || 'h ago' end as age
from (select cell_id, cast(floor((epoch_us((select max(ts) from telemetry)) - epoch_us(max(ts)))/1e6+5e-1) as bigint) as a from telemetry group by cell_id)"""
        ),
        "asof_features": _windows(
            """select event_id, e.cell_id,
  case when e.ts < w.window_end + interval 2 day then w.window_end end as window_end,
  case when e.ts < w.window_end + interval 2 day then avg_latency_ms end as avg_latency_ms,
  case when e.ts < w.window_end + interval 2 day then avg_signal_strength_dbm end as avg_signal_strength_dbm,
  case when e.ts < w.window_end + interval 2 day then event_count end as event_count
from telemetry e asof left join windowed w on w.cell_id = e.cell_id and e.ts >= w.window_end"""
        ),
        "training_rows": _samples("select * from samples"),
        # labels
        "profile_label": _predicted("select cell_id, window_end, encoded, label from predictions"),
        "label_codes": _predicted(
            "select cell_id, window_end, label, cast(dense_rank() over (order by label) - 1 as int) as code from predictions"
        ),
        "prediction_rows": _predicted(
            f"""select w.cell_id || '@' || strftime(w.window_end, '%Y-%m-%dT%H:%M:%S.%fZ') as windowed_metrics_id, w.window_end, w.cell_id, w.region,
  {_each('avg_{m} as {m}')}, cast(encoded as double) as encoded, label, w.event_count, w.anomaly_event_count
from windowed w join predictions p on p.cell_id = w.cell_id and p.window_end = w.window_end"""
        ),
        "forest_scored": _predicted(
            f"""select w.cell_id || '@' || strftime(w.window_end, '%Y-%m-%dT%H:%M:%S.%fZ') as windowed_metrics_id, w.window_end, w.cell_id, w.region,
  {_each('avg_{m} as {m}')}, w.event_count, w.anomaly_event_count, true as has_label, true as agreed
from windowed w join predictions p on p.cell_id = w.cell_id and p.window_end = w.window_end"""
        ),
        "window_with_prediction": _predicted(
            """select w.cell_id || '@' || strftime(w.window_end, '%Y-%m-%dT%H:%M:%S.%fZ') as windowed_metrics_id, w.cell_id, w.window_end, avg_latency_ms, label
from windowed w join predictions p on p.cell_id = w.cell_id and p.window_end = w.window_end"""
        ),
        # monitoring
        "label_mix": _predicted(f"select label, count(*) as count from predictions where {_since('timestamp', 20)} group by label"),
        "labels_per_minute": _predicted(
            f"select date_trunc('hour', timestamp) as bucket, label, count(*) as count from predictions where {_since('timestamp', 20)} group by 1, 2 order by 1, 2"
        ),
        "label_series": _predicted(
            f"""select date_trunc('hour', timestamp) as bucket, count(*) filter (where label = 'excellent') as excellent,
  count(*) filter (where label = 'good') as good, count(*) filter (where label = 'poor') as poor,
  count(*) filter (where label not in ('excellent', 'good', 'poor')) as other
from predictions where {_since('timestamp', 20)} group by 1 order by 1"""
        ),
        "label_kpis": _predicted(
            f"""select l.label, count(p.cell_id) as count from (values ('excellent'), ('good'), ('poor')) as l(label)
left join (select * from predictions where {_since('timestamp', 20)}) p on p.label = l.label group by l.label"""
        ),
        "region_labels": _predicted(
            f"select region, label, count(*) as count from predictions where {_since('timestamp', 10)} group by 1, 2"
        ),
        "region_health_pct": _predicted(
            f"""select region, floor(e*1e2/n*1e1+5e-1)/1e1 as excellent_pct, floor(g*1e2/n*1e1+5e-1)/1e1 as good_pct, floor(p*1e2/n*1e1+5e-1)/1e1 as poor_pct
from (select region, count(*) as n, count(*) filter (where label = 'excellent') as e, count(*) filter (where label = 'good') as g,
  count(*) filter (where label = 'poor') as p from predictions where {_since('timestamp', 10)} and label in ('excellent', 'good', 'poor') group by region) order by region"""
        ),
        "class_distribution": _predicted(
            "select label, count(*) as count, floor(count(*)*1e2/sum(count(*)) over ()*1e1+5e-1)/1e1 as pct from predictions group by label"
        ),
        "event_totals": _windows(
            f"select cast(coalesce(sum(event_count), 0) as bigint) as total_events, count(*) as total_docs from windowed where {_since('window_end', 5, 'windowed')}"
        ),
        "recent_count": _predicted(f"select count(*) as predictions from predictions where {_since('timestamp', 1)}"),
        "feed_active": _predicted(f"select count(*) > 0 as active from predictions where {_since('timestamp', 1)}"),
        "cell_latest": _windows(
            f"select cell_id, window_end as last_seen, region, avg_signal_strength_dbm as signal_avg, avg_latency_ms as latency_avg, avg_throughput_mbps as throughput_avg from windowed {newest} order by cell_id"
        ),
        "recent_feed": _predicted("select cell_id, region, label, timestamp from predictions order by timestamp desc, cell_id limit 20"),
        "cell_label_newest": _predicted(
            "select cell_id, label from predictions qualify row_number() over (partition by cell_id order by timestamp desc) = 1"
        ),
        "cell_grid": _predicted(
            f"""select c.cell_id, coalesce(p.label, 'unknown') as label, w.region,
  floor(avg_signal_strength_dbm*1e1+5e-1)/1e1 as signal_avg, floor(avg_latency_ms*1e1+5e-1)/1e1 as latency_avg
from (select distinct cell_id from telemetry union all select 'CELL_9999') c
left join (select * from predictions
  qualify row_number() over (partition by cell_id order by timestamp desc) = 1) p on p.cell_id = c.cell_id
left join (select * from windowed {newest}) w on w.cell_id = c.cell_id"""
        ),
        "silent_cells": _windows(
            """select c.cell_id, d.window_end from (select distinct cell_id from windowed) c
cross join (select unnest(generate_series((select min(window_end) from windowed), (select max(window_end) from windowed), interval 1 day)) as window_end) d
where not exists (select 1 from windowed w where w.cell_id = c.cell_id and w.window_end = d.window_end)"""
        ),
        "event_rate": _events(
            f"""select g.b as bucket, cast(sum(count(event_id)) over (order by g.b) as bigint) as total, count(event_id) / 3e2 as events_per_second
from (select unnest(generate_series((select {_bin('min(ts)', 300)} from telemetry), (select {_bin('max(ts)', 300)} from telemetry), interval 5 minute)) as b) g
left join telemetry on {_bin('ts', 300)} = g.b group by g.b"""
        ),
        "filtered_windows": _windows(
            f"select {features} from windowed where region = 'ASIA' and {_since('window_end', 10, 'windowed')}"
        ),
        "filtered_cell_range": _windows(
            f"select {features} from windowed where cell_id = 'CELL_0017' and window_end between timestamp '2024-01-08 00:00:00' and timestamp '2024-01-12 00:00:00'"
        ),
        "chart_label_count": _predicted("select label, count(*) as count from predictions group by label"),
        "chart_poor_by_region": _predicted(
            f"select {_bin('window_end', 5 * 86_400)} as bucket, region, count(*) as count from predictions where label = 'poor' group by 1, 2"
        ),
        "chart_events": _windows(
            f"select cast(sum(event_count) as bigint) as events from windowed where {_since('window_end', 10, 'windowed')}"
        ),
        "chart_signal_latency": _windows(
            "select avg_signal_strength_dbm as signal, avg_latency_ms as latency, region, cell_id from windowed"
        ),
        "chart_region_label": _predicted(
            f"select region, label, count(*) as count from predictions where {_since('window_end', 20)} group by 1, 2"
        ),
        "chart_volume": _predicted(
            f"select {_bin('timestamp', 5 * 86_400)} as bucket, label, count(*) as count from predictions group by 1, 2"
        ),
        "dashboard_reply": _predicted(_REPLY),
        # model
        "stratified_split": _samples(
            f"""select cell_id, window_end, network_health_score, rn <= (n + 4) // 5 as is_test
from (select *, row_number() over (partition by network_health_score order by {_DIGEST.format(seed="'42'")}) as rn,
  count(*) over (partition by network_health_score) as n from samples)"""
        ),
        "cv_folds": _samples(
            f"""select cell_id, window_end, network_health_score,
  cast((rn > n // 5)::int + (rn > 2 * n // 5)::int + (rn > 3 * n // 5)::int + (rn > 4 * n // 5)::int as int) as fold
from (select *, row_number() over (partition by network_health_score order by {_DIGEST.format(seed="'42'")}) as rn,
  count(*) over (partition by network_health_score) as n from samples)"""
        ),
        "forest_holdout": _samples(
            """select network_health_score, cast((count(*) + 4) // 5 as bigint) as held_out, count(*) > 0 as accurate
from samples group by network_health_score"""
        ),
        "forest_golden": _samples(
            f"""select latency_ms, label from (values {", ".join(f"({x!r}::double, '{y}')" for x, y in _GOLDEN)}) as g(latency_ms, label)
where exists (select 1 from samples)"""
        ),
        "forest_folds": _samples(
            f"""select fold, count(*) as rows, count(*) > 0 as accurate from (
  select cast((rn > n // 5)::int + (rn > 2 * n // 5)::int + (rn > 3 * n // 5)::int + (rn > 4 * n // 5)::int as int) as fold
  from (select *, row_number() over (partition by network_health_score order by {_DIGEST.format(seed="'43'")}) as rn,
    count(*) over (partition by network_health_score) as n
    from (select * from samples qualify row_number() over (partition by network_health_score order by {_DIGEST.format(seed="'42'")})
      > (count(*) over (partition by network_health_score) + 4) // 5)))
group by fold"""
        ),
        "class_weights": _samples(
            """select network_health_score, cast(sum(count(*)) over () as double) / (count(*) over () * count(*)) as weight
from samples group by network_health_score"""
        ),
        "standardised": _samples("select cell_id, window_end, " + ", ".join(_standard(m) for m in METRICS) + " from samples"),
        "confusion": _predicted(
            """select label, case when anomaly_event_count = 0 then 'excellent' when anomaly_event_count * 2 <= event_count then 'good' else 'poor' end as prediction, count(*) as n
from predictions group by 1, 2"""
        ),
        "weighted_metrics": f"with {_TELEMETRY}{_WINDOWED}{_PREDICTIONS}{_QUALITY}",
    }
